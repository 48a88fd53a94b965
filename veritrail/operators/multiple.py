"""Multiple-comparison corrections over a table of p-values, optionally one family per group.

Ranks are windows per family; a family is a batch of hypotheses, and each is handled on its own.
Ties share a rank order by the table's ``ordinal``; null or NaN p-values are never rejected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cleaning import check_alpha
from ..functions.constants import DEFAULT_SIGNIFICANCE_ALPHA


def _valid(p: Column) -> Column:
    return p.isNotNull() & ~F.isnan(p)


def bonferroni(p: Column, alpha: float, family: Sequence[str], ordinal: str) -> Column:
    m = F.count(F.lit(1)).over(W.partitionBy(*family))
    return F.coalesce(_valid(p) & (p <= F.lit(alpha) / m), F.lit(False))


def holm(p: Column, alpha: float, family: Sequence[str], ordinal: str) -> Column:
    order = W.partitionBy(*family).orderBy(p.asc_nulls_last(), ordinal)
    m, rank = F.count(F.lit(1)).over(W.partitionBy(*family)), F.row_number().over(order)
    fails = F.coalesce(~_valid(p) | (p > F.lit(alpha) / (m - rank + 1)), F.lit(True))
    return fails, order


def benjamini_hochberg(p: Column, alpha: float, family: Sequence[str], ordinal: str) -> Column:
    order = W.partitionBy(*family).orderBy(p.asc_nulls_last(), ordinal)
    m, rank = F.count(F.lit(1)).over(W.partitionBy(*family)), F.row_number().over(order)
    return F.coalesce(_valid(p) & (p <= rank / m * F.lit(alpha)), F.lit(False)), rank


def correct(df: DataFrame, p_col: str = "p_value", alpha: float = DEFAULT_SIGNIFICANCE_ALPHA, method: str = "bonferroni", family: Sequence[str] = (), ordinal: str = "ordinal") -> DataFrame:
    """df with significant_corrected."""
    check_alpha(alpha)
    p = F.col(p_col)
    if method == "bonferroni":
        return df.withColumn("significant_corrected", bonferroni(p, alpha, family, ordinal))
    if method == "holm":  # stop at the first failure
        fails, order = holm(p, alpha, family, ordinal)
        so_far = F.max("__fails").over(order.rowsBetween(W.unboundedPreceding, 0))
        return df.withColumn("__fails", fails).withColumn("significant_corrected", ~so_far).drop("__fails")
    if method == "fdr_bh":  # up to the largest rank that passes
        passes, rank = benjamini_hochberg(p, alpha, family, ordinal)
        last = F.max(F.when(F.col("__passes"), F.col("__rank"))).over(W.partitionBy(*family))
        return df.withColumns({"__passes": passes, "__rank": rank}).withColumn("significant_corrected", F.coalesce(F.col("__rank") <= last, F.lit(False)) & _valid(p)).drop("__passes", "__rank")
    raise ValueError(f"unknown method {method!r}: bonferroni, holm or fdr_bh")


def correction_summary(df: DataFrame, label_col: str = "label", p_col: str = "p_value", alpha: float = DEFAULT_SIGNIFICANCE_ALPHA, method: str = "bonferroni", family: Sequence[str] = (), ordinal: str = "ordinal") -> DataFrame:
    """label, p_value, significant_uncorrected, significant_corrected, method, n_tests (and the family)."""
    done = correct(df, p_col, alpha, method, family, ordinal)
    plain = F.coalesce(_valid(F.col(p_col)) & (F.col(p_col) <= alpha), F.lit(False))
    n = F.count(F.lit(1)).over(W.partitionBy(*family))
    return done.select(*family, F.col(label_col).alias("label"), F.col(p_col).alias("p_value"), plain.alias("significant_uncorrected"), "significant_corrected", F.lit(method).alias("method"), n.alias("n_tests"))


def _run(p_values: Sequence[float], alpha: float, method: str) -> list[bool]:
    check_alpha(alpha)
    if not len(p_values):
        return []
    rows = [(i, None if p is None else float(p)) for i, p in enumerate(p_values)]
    df = SparkSession.getActiveSession().createDataFrame(rows, "ordinal int, p_value double")
    return [r["significant_corrected"] for r in correct(df, "p_value", alpha, method).orderBy("ordinal").collect()]


def bonferroni_correction(p_values: Sequence[float], alpha: float = DEFAULT_SIGNIFICANCE_ALPHA) -> list[bool]:
    return _run(p_values, alpha, "bonferroni")


def holm_correction(p_values: Sequence[float], alpha: float = DEFAULT_SIGNIFICANCE_ALPHA) -> list[bool]:
    return _run(p_values, alpha, "holm")


def benjamini_hochberg_fdr(p_values: Sequence[float], alpha: float = DEFAULT_SIGNIFICANCE_ALPHA) -> list[bool]:
    return _run(p_values, alpha, "fdr_bh")


def summarize_correction(labels: Sequence[str], p_values: Sequence[float], alpha: float = DEFAULT_SIGNIFICANCE_ALPHA, method: str = "bonferroni") -> list[dict]:
    if len(labels) != len(p_values):
        raise ValueError("labels and p_values must have the same length")
    if method not in ("bonferroni", "holm", "fdr_bh"):
        raise ValueError(f"unknown method {method!r}: bonferroni, holm or fdr_bh")
    check_alpha(alpha)
    if not labels:
        return []
    rows = [(i, str(s), None if p is None else float(p)) for i, (s, p) in enumerate(zip(labels, p_values, strict=True))]
    df = SparkSession.getActiveSession().createDataFrame(rows, "ordinal int, label string, p_value double")
    done = correct(df, "p_value", alpha, method)
    return [
        {"label": r["label"], "p_value": r["p_value"], "significant_uncorrected": bool(r["p_value"] is not None and r["p_value"] <= alpha), "significant_corrected": r["significant_corrected"], "method": method, "n_tests": len(rows)}
        for r in done.orderBy("ordinal").collect()
    ]
