"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a 60-bit hash of the key.  Starting from one bucket, only
those above the byte limit split on their next bit.  The bytes under every prefix of a bounded resolution
come from one aggregation; prefixes that are still too large are refined further, up to all bits.

Rows that hash alike cannot be parted by bits: their bucket gets overflow pages.  Rows of more than half the
limit have a page each; the others fill pages in order (offsets are prefix sums over partitions, so no task sees
the whole bucket), which are half full at least.  A single row above the limit has a shard of its own.

Defined results: null keys hash as the empty text, null texts have no bytes; very long texts count whole; repeated
rows go to the same shard, or to its pages; an empty table gives an empty result; other columns are not read, and
key columns may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fits_broadcast, materialise

BITS = 60
LIMIT = 1 << 20
#: Bits of resolution beyond those that an even split needs, and added by a refinement.
SPARE = 4
BROADCAST_BYTES = 16 << 20


def key_hash(*keys: Column) -> Column:
    text = F.concat_ws("\x1f", *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def _prefix(depth: int) -> Column:
    return F.shiftright(F.col("h"), BITS - depth)


def _nodes(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Bytes and rows under every prefix of low..high bits."""
    fine = rows.groupBy(_prefix(high).alias("fine")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
    levels = fine.select("b", "n", "fine", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    anc = F.expr(f"shiftright(fine, {high} - depth)")
    return levels.groupBy("depth", anc.alias("prefix")).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))


def assign_shards(df: DataFrame, keys: list[str], size: Column, limit: int = LIMIT) -> DataFrame:
    """The key columns with n_bytes, shard_id (bits of the prefix, "#page" behind for overflow), depth,
    shard_bytes, shard_rows."""
    rows = materialise(df.select(F.struct(*keys).alias("__key"), size.cast("long").alias("n_bytes"), key_hash(*(F.col(k) for k in keys)).alias("h")), "shard-rows")
    total = rows.agg(F.sum("n_bytes").alias("b")).first()["b"] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE)
    waiting, leaves, pages = rows, None, None
    while True:
        nodes = materialise(_nodes(waiting, low, high), "shard-nodes")
        done = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)
        parents = nodes.where(~done).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fit = nodes.where(done & (F.col("depth") > low)).withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["depth", "parent"], "left_semi")
        fit = fit.drop("parent").unionByName(nodes.where(done & (F.col("depth") == low)))
        leaves = fit if leaves is None else leaves.unionByName(fit)
        large = nodes.where(~done & (F.col("depth") == high)).select("prefix")
        if large.isEmpty():
            break
        waiting = materialise(waiting.join(large, _prefix(high) == F.col("prefix"), "left_semi"), "shard-waiting")
        if high == BITS:
            pages = waiting
            break
        low, high = high + 1, min(BITS, high + 2 * SPARE)
    directory = materialise(leaves, "shard-directory")
    placed = _place(rows, directory, pages, limit)
    return placed.select(*(F.col(f"__key.`{k}`").alias(k) for k in keys), *placed.columns[1:])


def _place(rows: DataFrame, directory: DataFrame, pages: DataFrame | None, limit: int) -> DataFrame:
    """Look up each row's shard: one equality join per depth that has leaves, on the bits of that depth."""
    depths = [r["depth"] for r in directory.select("depth").distinct().orderBy("depth").collect()]
    small = fits_broadcast(directory, 32, BROADCAST_BYTES)
    # a row matches at exactly one depth: try all of them as one exploded key
    tries = F.array(*(F.struct(F.lit(d).alias("depth"), _prefix(d).alias("prefix")) for d in depths)) if depths else None
    kept = ["__key", "n_bytes", "shard_id", "depth", "shard_bytes", "shard_rows"]
    bits = F.expr(f"substring(lpad(bin(h), {BITS}, '0'), 1, depth)")
    if tries is None:
        found = rows.select("__key", "n_bytes", F.lit("").alias("shard_id"), F.lit(0).alias("depth"), F.col("n_bytes").alias("shard_bytes"), F.lit(1).cast("long").alias("shard_rows")).where("false")
    else:
        wide = rows.select("__key", "n_bytes", "h", F.explode(tries).alias("t")).select("__key", "n_bytes", "h", "t.depth", "t.prefix")
        found = wide.join(F.broadcast(directory) if small else directory, ["depth", "prefix"]).withColumn("shard_id", bits).select(*kept)
    if pages is None:
        return found
    every = materialise(pages.select("__key", "n_bytes", "h", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("rid")), "shard-overflow")
    alone = F.col("n_bytes") > limit / 2
    part = every.where(~alone)
    sums = part.groupBy("h", "part").agg(F.sum("n_bytes").alias("b"), F.max("n_bytes").alias("m"))
    by_hash = W.partitionBy("h")
    sums = sums.select("h", "part", (F.sum("b").over(by_hash.orderBy("part")) - F.col("b")).alias("before"), F.max("m").over(by_hash).alias("most"))
    local = F.sum("n_bytes").over(W.partitionBy("h", "part").orderBy("n_bytes", "rid").rowsBetween(W.unboundedPreceding, -1))
    placed = part.withColumn("ahead", F.coalesce(local, F.lit(0))).join(sums, ["h", "part"])
    page = F.floor((F.col("before") + F.col("ahead")) / F.greatest(F.lit(1), F.lit(limit) - F.col("most")))
    pooled = placed.select("__key", "n_bytes", "h", F.concat(F.lit("#"), page.cast("string")).alias("page"))
    own = every.where(alone).select("__key", "n_bytes", "h", F.concat(F.lit("##"), F.col("rid").cast("string")).alias("page"))
    placed = pooled.unionByName(own).withColumn("shard_id", F.concat(F.expr(f"lpad(bin(h), {BITS}, '0')"), "page")).withColumn("depth", F.lit(BITS))
    sized = placed.groupBy("shard_id").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return found.unionByName(placed.join(sized, "shard_id").select(*kept))


def write_shards(df: DataFrame, placed: DataFrame, key: str, path: str) -> None:
    """Write a table with unique keys as one folder per shard."""
    df.join(placed.select(key, "shard_id"), key).repartition("shard_id").write.partitionBy("shard_id").parquet(path)


ORACLE = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS h
  FROM documents
), deep AS (
  SELECT d.*, CAST(g.depth AS INTEGER) AS depth, h >> CAST({BITS} - g.depth AS INTEGER) AS prefix
  FROM d, (SELECT unnest(generate_series(0, {BITS})) AS depth) g
), sized AS (
  SELECT *, sum(n_bytes) OVER p AS shard_bytes, count(*) OVER p AS shard_rows FROM deep WINDOW p AS (PARTITION BY depth, prefix)
), leaf AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM sized WHERE shard_bytes <= {LIMIT} OR shard_rows = 1
)
SELECT doc_id, n_bytes, left(lpad(bin(h), {BITS}, '0'), depth) AS shard_id, depth,
       CAST(shard_bytes AS BIGINT) AS shard_bytes, CAST(shard_rows AS BIGINT) AS shard_rows
FROM leaf WHERE k = 1
"""
