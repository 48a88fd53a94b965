"""The corpus operators as registered queries (and their SQL, where SQL can express them)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, gif, langid, lines, mixing, packing, sharding, simhash, token_counts, toxicity
from .common import TEXTS, materialise, read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(gif.read_payloads(gif.encode_payloads(read_table(spark, sf_dir, "documents"))), "gif-digests", TEXTS)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"))


def op4_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs, ["doc_id"], F.coalesce(F.octet_length("text"), F.lit(0)))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), ["doc_id", "source"])


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(langid.identify(read_table(spark, sf_dir, "documents")), "languages", TEXTS)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digest(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")), "toxicity", TEXTS)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_gif_media,
        op3_token_counts,
        op4_extendible_sharding,
        op5_source_mixing,
        op6_embedding_dedup,
        op7_simhash,
        op8_language_id,
        op9_line_dedup,
        op10_toxicity,
    )
}

#: Where SQL can say the same on whole tables in bearable time.
ORACLE_SQL: dict[str, str] = {
    "op4_extendible_sharding": sharding.ORACLE,
    "op5_source_mixing": mixing.ORACLE,
    "op9_line_dedup": lines.ORACLE,
}
