"""Walk-forward validation: split, purge and embargo, two statistics, one verdict, in one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .stats import STAT_FIELDS, StatResult, StatSpec, evaluate, evaluate_callable, to_result
from .timeline import KEY, date_key, date_sort_key, roles, split_bounds
from .verdict import classify


@dataclass(frozen=True)
class WalkForwardResult:
    train: StatResult
    test: StatResult
    retention_ratio: float | None
    sign_flipped: bool
    verdict: str
    reasoning: str
    n_purged_train: int = 0
    n_embargoed_test: int = 0


def _empty_stat(n: Column) -> Column:
    none = {"mean": "double", "t_stat": "double", "n_clusters": "bigint", "df": "double"}
    return F.struct(*((n.cast("bigint") if f == "n" else F.lit(False) if f == "significant" else F.lit(None).cast(none[f])).alias(f) for f in STAT_FIELDS))


def walk_forward(
    df: DataFrame, date_col: str, stat: StatSpec | Callable, train_frac: float = K.DEFAULT_TRAIN_FRAC, min_n_per_split: int = K.DEFAULT_MIN_N_PER_SPLIT,
    significance_t: float | None = None, purge_days: float = 0, embargo_days: float = 0,
) -> DataFrame:
    """One row: train, test (structs), retention_ratio, sign_flipped, verdict, reasoning, n_purged_train,
    n_embargoed_test.  Nothing runs until an action; missing dates count as the last ones."""
    keyed = df.withColumn(KEY, date_key(df, date_col))
    marked = roles(keyed, split_bounds(keyed, train_frac), purge_days, embargo_days)
    counts = marked.groupBy().pivot("role", ["train", "test", "purged", "embargoed"]).count()
    used = marked.where(F.col("role").isin("train", "test"))
    if isinstance(stat, StatSpec):
        stats = evaluate(used, stat, ["role"])
    else:
        stats = evaluate_callable(used.drop(KEY).select("role", *df.columns), stat, ["role"], [date_col])
    pick = lambda r: F.max(F.when(F.col("role") == r, F.struct(*STAT_FIELDS))).alias(r + "_stat")
    both = counts.crossJoin(stats.agg(pick("train"), pick("test")))
    n = {r: F.coalesce(F.col(r), F.lit(0)) for r in ("train", "test", "purged", "embargoed")}
    short = (n["train"] < min_n_per_split) | (n["test"] < min_n_per_split)
    train = F.when(short | F.col("train_stat").isNull(), _empty_stat(n["train"])).otherwise(F.col("train_stat"))
    test = F.when(short | F.col("test_stat").isNull(), _empty_stat(n["test"])).otherwise(F.col("test_stat"))
    one = both.select(train.alias("train"), test.alias("test"), short.alias("short"), n["train"].alias("n_train"), n["test"].alias("n_test"), n["purged"].alias("n_purged_train"), n["embargoed"].alias("n_embargoed_test"))
    one = one.withColumn("c", classify(F.col("train"), F.col("test"), significance_t))
    dropped = F.when((F.col("n_purged_train") > 0) | (F.col("n_embargoed_test") > 0), F.format_string(" (%d rows purged from train, %d embargoed in test)", "n_purged_train", "n_embargoed_test")).otherwise("")
    low = lambda s: F.when(F.col(s)["n_clusters"] < K.MIN_RELIABLE_CLUSTERS, F.format_string(f"{s} has %d", F.col(s)["n_clusters"]))
    few = F.concat_ws(", ", low("train"), low("test"))
    caveat = F.when(~F.col("short") & (few != ""), F.concat(F.lit(f" CAVEAT: fewer than {K.MIN_RELIABLE_CLUSTERS} clusters ("), few, F.lit("); treat the verdict as inconclusive"))).otherwise("")
    why = F.when(F.col("short"), F.format_string(f"%d rows to train and %d to test: each side needs {min_n_per_split}", "n_train", "n_test")).otherwise(F.col("c.reasoning"))
    return one.select(
        "train", "test", F.when(~F.col("short"), F.col("c.retention_ratio")).alias("retention_ratio"),
        (~F.col("short") & F.col("c.sign_flipped")).alias("sign_flipped"),
        F.when(F.col("short"), K.INSUFFICIENT_DATA).otherwise(F.col("c.verdict")).alias("verdict"),
        F.concat(why, dropped, caveat).alias("reasoning"), "n_purged_train", "n_embargoed_test",
    )


def walk_forward_validate(df: DataFrame, date_col: str, stat_fn: StatSpec | Callable, **options) -> WalkForwardResult:
    """The same, run: dates are checked first, and the row comes back as a record."""
    date_sort_key(df, date_col)
    row = walk_forward(df, date_col, stat_fn, **options).first()
    return WalkForwardResult(
        to_result(row["train"]), to_result(row["test"]), row["retention_ratio"], row["sign_flipped"], row["verdict"], row["reasoning"], row["n_purged_train"], row["n_embargoed_test"]
    )
