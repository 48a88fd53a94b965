"""Ids beyond 2^53, negative, null and repeated ones, in one table, through every operator."""

import random
from collections import Counter

import pytest
from conftest_words import sentence
from veritrail.llm import embeddings, gif, langid, lines, mixing, packing, sharding, simhash, token_counts, toxicity
from pyspark.sql import functions as F

BIG = 1 << 60
IDS = [BIG + 1, BIG + 3, -5, None, 7, 7, None, -BIG - 1]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    rows = [(i, sentence(rng, 40), "en", "s") for i in [*IDS, *range(100, 140)]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).cache()


RESULTS = {
    "op1": lambda d: packing.pack_documents(d),
    "op2": lambda d: gif.read_payloads(gif.encode_payloads(d)),
    "op3": lambda d: token_counts.count_tokens(d),
    "op4": lambda d: sharding.assign_shards(d, ["doc_id"], F.octet_length("text")),
    "op5": lambda d: mixing.replicate(d, d.sparkSession.createDataFrame([("s", 1e-9)], "source string, rate double"), ["doc_id"]),
    "op6": lambda d: embeddings.near_duplicates(d.select(F.col("doc_id").alias("vec_id"), F.array(F.rand(1), F.rand(2), F.lit(1.0)).alias("embedding"), F.lit(1).alias("label"))).withColumnRenamed("vec_id", "doc_id"),
    "op7": lambda d: simhash.simhash_components(d),
    "op8": lambda d: langid.identify(d),
    "op9": lambda d: lines.line_digest(d),
    "op10": lambda d: toxicity.score_documents(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))),
}


@pytest.mark.parametrize("name", sorted(RESULTS))
def test_ids_are_exact(docs, name):
    want = Counter(r.doc_id for r in docs.select("doc_id").collect())
    got = Counter(r.doc_id for r in RESULTS[name](docs).select("doc_id").collect())
    assert got == (Counter() if name == "op5" else want)


def test_copies_carry_ids(docs):
    rate = docs.sparkSession.createDataFrame([("s", 3.0)], "source string, rate double")
    got = Counter(r.doc_id for r in mixing.replicate(docs, rate, ["doc_id"]).collect())
    assert set(got) <= {r.doc_id for r in docs.collect()} and {BIG + 1, BIG + 3} & set(got)


def test_merged_sequences_keep_ids(docs):
    split = docs.repartition(20)  # underfull bins meet in later rounds
    assert Counter(r.doc_id for r in packing.pack_documents(split).collect()) == Counter(r.doc_id for r in docs.collect())
