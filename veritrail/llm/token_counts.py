"""Token counts through a digest cache.

Every text has a digest of its normalised content and the tokenizer's version; counts are stored under
that digest.  Texts whose digest is in the cache cost one narrow join; of the others each distinct one
is encoded once and its count appended.

Normalisation: null is empty; runs of blanks, tabs and line breaks become one blank (the tokenizer drops
white space itself, so no count changes).  Defined results: repeated texts share one entry; empty tables
append nothing; an unreadable or absent cache folder is an empty cache.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, batches, hot_keys, join_hot, materialise, scratch_path, text_or_empty
from .tokens import encoder, vocabulary

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
_CACHE = "version string, digest binary, n_tokens long"


def tokenizer_version(vocabulary_name: str) -> str:
    with open(vocabulary(vocabulary_name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


def _exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_cache(spark, cache_path: str, version: str) -> DataFrame:
    if not _exists(spark, cache_path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return spark.read.schema(_CACHE).parquet(cache_path).where(F.col("version") == version).select("digest", "n_tokens")


def count_tokens(docs: DataFrame, cache_path: str | None = None, vocabulary_name: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; new counts are appended to the cache.

    ``cache_path`` None: a cache of its own, empty at the start.
    """
    spark = docs.sparkSession
    version = tokenizer_version(vocabulary_name)
    cache_path = cache_path or scratch_path(spark, "token-cache")
    cached = read_cache(spark, cache_path, version)
    content = F.regexp_replace(F.col("text"), "[ \\t\\n\\r]+", " ")
    digest = F.unhex(F.sha2(F.concat(F.lit(version + ":"), content), 256))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    keyed = materialise(source.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest.alias("digest")), "token-keys")

    def squeeze(frames):
        """Once per digest and input partition, and compressed: what crosses the network."""
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        seen: set[bytes] = set()
        for frame in frames:
            keep = []
            for k, d in enumerate(frame["digest"]):
                if d not in seen:
                    keep.append(k)
                    if len(seen) < 1_000_000:
                        seen.add(d)
            part = frame.iloc[keep]
            yield pd.DataFrame({"digest": part["digest"], "body": [pack.compress(t.encode("utf-8", "surrogatepass")) for t in part["text"]]})

    def encode(frames):
        import zstandard

        unpack, code = zstandard.ZstdDecompressor(), encoder(vocabulary(vocabulary_name))
        for frame in frames:
            counts = [code.count(unpack.decompress(bytes(b)).decode("utf-8", "surrogatepass")) for b in frame["body"]]
            yield pd.DataFrame({"version": version, "digest": frame["digest"], "n_tokens": counts})

    bodies = source.select(digest.alias("digest"), "text").mapInPandas(squeeze, "digest binary, body binary")
    misses = bodies.join(cached, "digest", "left_anti").groupBy("digest").agg(F.first("body").alias("body"))
    # counts are small: the results of eight tasks share a file
    counted = misses.select("body", "digest").mapInPandas(encode, _CACHE).withColumn("file", F.expr("spark_partition_id() div 8"))
    with batches(spark, TEXTS):
        counted.repartition("file").drop("file").write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path, version)
    twice = counts.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():  # another job appended the same texts meanwhile
        counts = materialise(counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return join_hot(keyed, counts, "digest", hot_keys(keyed, "digest")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
