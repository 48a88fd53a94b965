"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of times that each of its documents is to appear.  A document's number
of copies inverts the Poisson distribution of that mean at a hash of its id and the seed, so it is the same
in every run and in every place; documents are exploded by it and shuffled globally by another hash.

Large means are the sum of draws with means of at most ``STEP``, so the inversion stays exact.
Defined results: a null source is a source named by the empty text; null ids hash as the empty text; texts of any
length count by their bytes and are carried whole; repeated rows get equal copies; sources that have no weight do not appear; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, materialise

SEED, STEP = 2024, 16.0
#: Source weights are the sources' bytes to this power (1: as they are, 0: all equal).
TEMPERATURE = 0.5
BROADCAST_BYTES = 8 << 20


def _hash60(*parts: Column) -> Column:
    text = F.concat_ws(":", *parts)
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def source_sizes(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("bytes"))


def tempered_weights(sizes: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    return sizes.select("source", F.pow(F.col("bytes").cast("double"), F.lit(temperature)).alias("weight"))


def rates(sizes: DataFrame, weights: DataFrame, volume: float = 1.0) -> DataFrame:
    """source, rate: mean repetitions that give each source its share of ``volume`` times all bytes."""
    both = sizes.join(weights, "source").where("bytes > 0 and weight > 0")
    whole = both.agg(F.sum("weight").alias("weights"), (F.sum("bytes") * F.lit(volume)).alias("target"))
    return both.crossJoin(F.broadcast(whole)).select("source", (F.col("weight") / F.col("weights") * F.col("target") / F.col("bytes")).alias("rate"))


def _with_steps(table: DataFrame) -> DataFrame:
    """Adds draws and cdf: the values of the distribution function, as far as it can be told from 1."""
    lam = F.col("lam")
    table = table.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP).cast("int"))).withColumn("lam", F.col("rate") / F.col("draws"))
    terms = F.expr("cast(ceil(lam + 12 * sqrt(lam) + 24) as int)")
    first = F.struct(F.exp(-lam).alias("p"), F.array(F.exp(-lam)).alias("c"))

    def extend(state, k):
        p = state["p"] * lam / k
        return F.struct(p.alias("p"), F.concat(state["c"], F.array(F.element_at(state["c"], -1) + p)).alias("c"))

    return table.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), terms), first, extend, lambda s: s["c"])).drop("lam", "rate")


def copies_column(doc_id: Column, draws: Column, cdf: Column, seed: int = SEED) -> Column:
    def draw(j):
        u = _hash60(F.lit(str(seed)), _id(doc_id), j.cast("string")) / F.lit(float(1 << 60))
        return F.size(F.filter(cdf, lambda c: c <= u))

    return F.aggregate(F.transform(F.sequence(F.lit(1), draws), draw), F.lit(0), lambda a, x: a + x)


def replicate(docs: DataFrame, table: DataFrame, columns: list[str], seed: int = SEED) -> DataFrame:
    """Copies of the documents (``columns``, copy from 1, n_copies, shuffle_key), in shuffled order.

    Rows are dealt out by a hash of id and copy and sorted by it within each part; parts and order
    together are a random permutation that depends on the seed alone.
    """
    steps = materialise(_with_steps(table), "mix-rates")
    side = steps.select(F.col("source").alias("__source"), "draws", "cdf")
    if fits_broadcast(steps, 1024, BROADCAST_BYTES):
        side = F.broadcast(side)
    row = docs.select(F.struct(*columns).alias("__row"), F.col("doc_id").alias("__id"), F.coalesce("source", F.lit("")).alias("__source"))
    drawn = row.join(side, "__source").select("__row", "__id", copies_column(F.col("__id"), F.col("draws"), F.col("cdf"), seed).alias("__n")).where("__n > 0")
    each = drawn.select("__row", "__id", "__n", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__copy"))
    key = _hash60(F.lit(f"{seed}s"), _id(F.col("__id")), F.col("__copy").cast("string"))
    dealt = each.withColumn("__key", key).repartition("__key").sortWithinPartitions("__key")
    return dealt.select(*(F.col("__row")[c].alias(c) for c in columns), F.col("__copy").alias("copy"), F.col("__n").alias("n_copies"), F.col("__key").alias("shuffle_key"))


def mix(docs: DataFrame, columns: list[str], temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    sizes = materialise(source_sizes(docs), "mix-sizes")
    return replicate(docs, rates(sizes, tempered_weights(sizes, temperature)), columns, seed)


ORACLE = f"""
WITH sizes AS (
  SELECT coalesce(source, '') AS source, CAST(sum(coalesce(strlen(text), 0)) AS DOUBLE) AS bytes FROM documents GROUP BY 1
), weighted AS (
  SELECT source, bytes, pow(bytes, {TEMPERATURE}::DOUBLE) AS weight FROM sizes WHERE bytes > 0
), rated AS (
  SELECT source, weight / sum(weight) OVER () * sum(bytes) OVER () / bytes AS rate FROM weighted
), stepped AS (
  SELECT source, greatest(1, CAST(ceil(rate / {STEP}::DOUBLE) AS INTEGER)) AS draws, rate / greatest(1, ceil(rate / {STEP}::DOUBLE)) AS lam FROM rated
), cdf AS (
  SELECT source, k, sum(exp(-lam + k * ln(lam) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM stepped, (SELECT unnest(generate_series(0, 120)) AS k) g
), uniform AS (
  SELECT d.doc_id, d.source, s.source AS src, ('0x' || substr(md5('{SEED}:' || d.doc_id || ':' || j.j), 1, 15))::BIGINT / {float(1 << 60)}::DOUBLE AS u
  FROM documents d JOIN stepped s ON coalesce(d.source, '') = s.source, LATERAL (SELECT unnest(generate_series(1, s.draws)) AS j) j
), drawn AS (
  SELECT doc_id, any_value(source) AS source, CAST(sum(n) AS INTEGER) AS n_copies
  FROM (SELECT u.doc_id, u.source, (SELECT count(*) FROM cdf c WHERE c.source = u.src AND c.c <= u.u) AS n FROM uniform u) GROUP BY doc_id
)
SELECT doc_id, source, CAST(k.k AS INTEGER) AS copy, n_copies, ('0x' || substr(md5('{SEED}s:' || doc_id || ':' || k.k), 1, 15))::BIGINT AS shuffle_key
FROM drawn, LATERAL (SELECT unnest(generate_series(1, n_copies)) AS k) k WHERE n_copies > 0
"""
