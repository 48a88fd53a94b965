"""Cross-sectional regressions per cohort, and the test of the estimate series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.cleaning import all_finite, check_alpha, finite
from ..functions.student import two_sided_p


@dataclass(frozen=True)
class FamaMacBethResult:
    period_estimates: dict
    mean_estimate: float | None
    std_estimate: float | None
    t_stat: float | None
    p_value: float | None
    n_periods: int
    significant: bool
    dropped_cohorts: list = field(default_factory=list)


@dataclass(frozen=True)
class FamaMacBethMultiResult:
    period_estimates: dict
    mean_estimate: dict
    std_estimate: dict
    t_stat: dict
    p_value: dict
    n_periods: int
    significant: dict
    dropped_cohorts: list = field(default_factory=list)


def _present(df: DataFrame, cohort_col: str) -> DataFrame:
    """Rows whose cohort is neither null nor NaN."""
    c = F.col(cohort_col)
    odd = F.isnan(c) if dict(df.dtypes)[cohort_col] in ("double", "float") else F.lit(False)
    return df.where(c.isNotNull() & ~odd)


def cohort_slopes(df: DataFrame, cohort_col: str, x_col: str, y_col: str, min_obs: int = K.DEFAULT_MIN_OBS_PER_COHORT, winsorize_x_pct: float | None = None) -> DataFrame:
    """cohort, n, estimate (slope of y on x; null if dropped), dropped.

    Too few clean rows or a constant x drop a cohort.  Winsorizing clips x to the cohort's own percentiles
    of its clean rows; they come from one aggregation that is joined back (one row per cohort).
    """
    ok = all_finite(x_col, y_col)
    rows = _present(df, cohort_col).select(F.col(cohort_col).alias("cohort"), F.when(ok, F.col(x_col).cast("double")).alias("x"), F.when(ok, F.col(y_col).cast("double")).alias("y"))
    if winsorize_x_pct:
        edges = rows.groupBy("cohort").agg(F.percentile("x", F.array(F.lit(float(winsorize_x_pct)), F.lit(1 - float(winsorize_x_pct)))).alias("e"))
        rows = rows.join(edges, "cohort").withColumn("x", F.when(F.col("x").isNotNull(), F.greatest(F.least("x", F.col("e")[1]), F.col("e")[0])))
    fit = rows.groupBy("cohort").agg(F.count("x").alias("n"), (F.min("x") < F.max("x")).alias("varies"), F.regr_slope("y", "x").alias("slope"))
    return _flagged(fit, (F.col("n") >= min_obs) & F.coalesce("varies", F.lit(False)))


def cohort_group_diffs(df: DataFrame, cohort_col: str, group_col: str, y_col: str, min_obs: int = K.DEFAULT_MIN_OBS_PER_COHORT) -> DataFrame:
    """cohort, n, estimate (mean of y where the group is true less where it is false), dropped."""
    g = F.col(group_col).cast("double")
    ok = finite(g) & finite(y_col)
    y, side = F.col(y_col).cast("double"), g != 0
    fit = _present(df, cohort_col).groupBy(F.col(cohort_col).alias("cohort")).agg(
        F.count_if(ok).alias("n"), F.count_if(ok & side).alias("n1"), F.count_if(ok & ~side).alias("n0"),
        (F.avg(F.when(ok & side, y)) - F.avg(F.when(ok & ~side, y))).alias("slope"),
    )
    return _flagged(fit, (F.col("n") >= min_obs) & (F.col("n1") >= 2) & (F.col("n0") >= 2))


def _flagged(fit: DataFrame, good: Column) -> DataFrame:
    return fit.select("cohort", "n", F.when(good, F.col("slope")).alias("estimate"), (~good).alias("dropped"))


def cohort_multi_slopes(df: DataFrame, cohort_col: str, x_cols: Sequence[str], y_col: str, min_obs: int = K.DEFAULT_MIN_OBS_PER_COHORT) -> DataFrame:
    """cohort, n, x_col, estimate, dropped: one row per cohort and regressor.

    A cohort's least squares needs only its second moments, so one aggregation per cohort (built-in,
    combined map-side) gathers them and a small solve runs on one row per cohort.  Moments are centred by
    the aggregates themselves and regressors are scaled to unit variance; a cohort whose scaled matrix is
    rank deficient is dropped.
    """
    xs, k = list(x_cols), len(x_cols)
    ok = all_finite(*xs, y_col)
    val = lambda c: F.when(ok, F.col(c).cast("double"))
    cols = [*xs, y_col]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    moments = _present(df, cohort_col).groupBy(F.col(cohort_col).alias("cohort")).agg(
        F.count_if(ok).alias("n"), *(F.covar_pop(val(cols[i]), val(cols[j])).alias(f"m{i}_{j}") for i, j in pairs)
    )

    @F.pandas_udf("array<double>")
    def solve(n: pd.Series, moments: pd.Series) -> pd.Series:
        out = []
        for count, row in zip(n, moments, strict=True):
            full = np.zeros((k + 1, k + 1))
            for (i, j), m in zip(pairs, row, strict=True):
                full[i, j] = full[j, i] = np.nan if m is None else m
            scale = np.sqrt(np.diag(full)[:k])
            if count < min_obs or count <= k + 1 or not np.isfinite(full).all() or not (scale > 0).all():
                out.append(None)
                continue
            a = full[:k, :k] / np.outer(scale, scale)
            out.append(None if np.linalg.matrix_rank(a, tol=1e-10) < k else (np.linalg.solve(a, full[:k, k] / scale) / scale).tolist())
        return pd.Series(out)

    fit = moments.withColumn("b", solve(F.col("n"), F.array(*(F.col(f"m{i}_{j}") for i, j in pairs))))
    named = F.arrays_zip(F.array(*(F.lit(x) for x in xs)).alias("x_col"), F.coalesce("b", F.array(*[F.lit(None).cast("double")] * k)).alias("estimate"))
    return fit.select("cohort", "n", F.explode(named).alias("e"), F.col("b").isNull().alias("dropped")).select("cohort", "n", F.col("e.x_col").alias("x_col"), F.col("e.estimate").alias("estimate"), "dropped")


def estimate_test(
    estimates: DataFrame, by: Sequence[str] = (), significance_alpha: float = K.DEFAULT_SIGNIFICANCE_ALPHA, min_periods: int = K.DEFAULT_MIN_PERIODS, newey_west_lags: int | None = None
) -> DataFrame:
    """mean_estimate, std_estimate, t_stat, p_value, n_periods, significant of the series of estimates that
    were not dropped.  The lag window runs over cohorts (one row each), not over data."""
    check_alpha(significance_alpha)
    kept = estimates.where(~F.col("dropped"))
    lags = int(newey_west_lags or 0)
    order = W.partitionBy(*by).orderBy("cohort")
    centred = kept.withColumn("u", F.col("estimate") - F.avg("estimate").over(W.partitionBy(*by)))
    aggs = [F.count("*").alias("n"), F.avg("estimate").alias("m"), F.stddev_samp("estimate").alias("s"), F.sum(F.col("u") * F.col("u")).alias("g0"), F.max("estimate").alias("hi"), F.min("estimate").alias("lo")]
    for lag in range(1, lags + 1):
        centred = centred.withColumn(f"l{lag}", F.col("u") * F.lag("u", lag).over(order))
        aggs.append(F.sum(f"l{lag}").alias(f"g{lag}"))
    a = (centred.groupBy(*by) if by else centred).agg(*aggs)
    n = F.col("n")
    se = F.col("s") / F.sqrt(n)
    if lags:
        total = F.col("g0")
        for lag in range(1, lags + 1):
            total = total + 2 * (1 - lag / (lags + 1)) * F.coalesce(f"g{lag}", F.lit(0.0))
        se = F.sqrt(F.greatest(total / n, F.lit(0.0)) / n)
    t = F.when((n >= max(min_periods, 2)) & (se != 0) & (F.col("lo") < F.col("hi")), F.col("m") / F.when(se != 0, se))
    p = two_sided_p(t, (n - 1).cast("double"))
    out = a.select(*by, F.when(n >= 2, F.col("m")).alias("mean_estimate"), F.when(n >= 2, F.col("s")).alias("std_estimate"), t.alias("t_stat"), p.alias("p_value"), n.alias("n_periods"))
    return out.withColumn("significant", F.coalesce(F.col("p_value") < significance_alpha, F.lit(False)))


def _record(estimates: DataFrame, **options) -> FamaMacBethResult:
    """Estimates are one row per cohort, which a record holds anyway."""
    rows = estimates.orderBy("cohort").collect()
    test = estimate_test(estimates.sparkSession.createDataFrame(rows, estimates.schema), **options).first()
    series = {r["cohort"]: r["estimate"] for r in rows if not r["dropped"]}
    return FamaMacBethResult(series, *(test[c] for c in ("mean_estimate", "std_estimate", "t_stat", "p_value", "n_periods", "significant")), [r["cohort"] for r in rows if r["dropped"]])


def fama_macbeth_regression(
    df: DataFrame, cohort_col: str, x_col: str, y_col: str, min_obs_per_cohort: int = K.DEFAULT_MIN_OBS_PER_COHORT, significance_alpha: float = K.DEFAULT_SIGNIFICANCE_ALPHA,
    min_periods: int = K.DEFAULT_MIN_PERIODS, newey_west_lags: int | None = None, winsorize_x_pct: float | None = None,
) -> FamaMacBethResult:
    slopes = cohort_slopes(df, cohort_col, x_col, y_col, min_obs_per_cohort, winsorize_x_pct)
    return _record(slopes, significance_alpha=significance_alpha, min_periods=min_periods, newey_west_lags=newey_west_lags)


def fama_macbeth_group_diff(
    df: DataFrame, cohort_col: str, group_col: str, y_col: str, min_obs_per_cohort: int = K.DEFAULT_MIN_OBS_PER_COHORT, significance_alpha: float = K.DEFAULT_SIGNIFICANCE_ALPHA,
    min_periods: int = K.DEFAULT_MIN_PERIODS, newey_west_lags: int | None = None,
) -> FamaMacBethResult:
    diffs = cohort_group_diffs(df, cohort_col, group_col, y_col, min_obs_per_cohort)
    return _record(diffs, significance_alpha=significance_alpha, min_periods=min_periods, newey_west_lags=newey_west_lags)


def fama_macbeth_multi_regression(
    df: DataFrame, cohort_col: str, x_cols: Sequence[str], y_col: str, min_obs_per_cohort: int = K.DEFAULT_MIN_OBS_PER_COHORT, significance_alpha: float = K.DEFAULT_SIGNIFICANCE_ALPHA,
    min_periods: int = K.DEFAULT_MIN_PERIODS, newey_west_lags: int | None = None,
) -> FamaMacBethMultiResult:
    slopes = cohort_multi_slopes(df, cohort_col, x_cols, y_col, min_obs_per_cohort)
    rows = slopes.orderBy("cohort", "x_col").collect()
    local = df.sparkSession.createDataFrame(rows, slopes.schema)
    tests = {r["x_col"]: r for r in estimate_test(local, ["x_col"], significance_alpha, min_periods, newey_west_lags).collect()}
    series: dict = {}
    for r in rows:
        if not r["dropped"]:
            series.setdefault(r["cohort"], {})[r["x_col"]] = r["estimate"]
    part = lambda name, missing=None: {x: tests[x][name] if x in tests else missing for x in x_cols}
    dropped = list(dict.fromkeys(r["cohort"] for r in rows if r["dropped"]))
    return FamaMacBethMultiResult(series, part("mean_estimate"), part("std_estimate"), part("t_stat"), part("p_value"), len(series), part("significant", False), dropped)
