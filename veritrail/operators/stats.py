"""One-sample and two-group t statistics as grouped aggregates.

Each regression has one coefficient of interest, so every standard error is an aggregate of one influence
value per row: plain from the residual variance, cluster-robust from sums per cluster (two-level
aggregation), Newey-West from products with lagged rows.  ``evaluate`` computes any of them for every group
of ``by`` in one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cleaning import as_column, finite, ratio
from ..functions.constants import DEFAULT_SIGNIFICANCE_ALPHA
from ..functions.student import critical

STAT_SCHEMA = "mean double, t_stat double, n bigint, significant boolean, n_clusters bigint, df double"
STAT_FIELDS = ("mean", "t_stat", "n", "significant", "n_clusters", "df")


@dataclass(frozen=True)
class StatResult:
    mean: float | None
    t_stat: float | None
    n: int
    significant: bool
    n_clusters: int | None = None
    df: float | None = None


@dataclass(frozen=True)
class StatSpec:
    """What to test: the mean of ``value`` against zero, or its difference between the rows where ``group``
    is true and false.  ``cluster`` takes priority over ``maxlags`` (which needs ``order``) as long as there
    are two clusters."""

    value: str | Column
    group: str | Column | None = None
    cluster: str | Column | None = None
    maxlags: int | None = None
    order: Sequence[str | Column] = ()
    significance_t: float | None = None

    @property
    def parameters(self) -> int:
        return 1 if self.group is None else 2


def vs_zero(value, cluster=None, maxlags=None, order=(), significance_t=None) -> StatSpec:
    return StatSpec(value, None, cluster, maxlags, order, significance_t)


def group_diff(value, group, cluster=None, maxlags=None, order=(), significance_t=None) -> StatSpec:
    return StatSpec(value, group, cluster, maxlags, order, significance_t)


def significant(t: Column, df: Column, significance_t: float | None = None, alpha: float = DEFAULT_SIGNIFICANCE_ALPHA) -> Column:
    bound = F.lit(float(significance_t)) if significance_t is not None else critical(df, alpha)
    return F.coalesce(~F.isnan(t) & (F.abs(t) >= bound), F.lit(False))


def evaluate(rows: DataFrame, spec: StatSpec, by: Sequence[str] = ()) -> DataFrame:
    """One row per group of ``by`` (one row in all without): the columns of STAT_SCHEMA and n_rows, the rows
    before cleaning.  Group columns must not be null."""
    by = list(by)
    if spec.maxlags is not None and not spec.order:
        raise ValueError("Newey-West statistics need order columns")
    data = _picked(rows, spec, by)
    base = data.groupBy(*by).agg(F.count("*").alias("n_rows"), *_side("1", F.col("__g")), *_side("0", ~F.col("__g")))
    base = _with_model(base, spec)
    hac = _lag_products(data, base, spec, by) if spec.maxlags is not None else None
    sums = None
    if spec.cluster is not None:
        yes, no = F.when(F.col("__g"), F.col("__v")), F.when(~F.col("__g"), F.col("__v"))
        sums = data.where("__v is not null").groupBy(*by, "__c").agg(F.sum(yes).alias("s1"), F.count(yes).alias("k1"), F.sum(no).alias("s0"), F.count(no).alias("k0"))
    return _finish(base, spec, by, hac, sums)


def _picked(rows: DataFrame, spec: StatSpec, by: list[str]) -> DataFrame:
    """by, __v (null where the row is not clean), __g, and what cluster and order need."""
    v = as_column(spec.value).cast("double")
    ok = finite(v) & finite(as_column(spec.group).cast("double")) if spec.group is not None else finite(v)
    side = as_column(spec.group).cast("double") != 0 if spec.group is not None else F.lit(True)
    picked = [*(F.col(b) for b in by), F.when(ok, v).alias("__v"), F.when(ok, side).alias("__g")]
    if spec.cluster is not None:
        blank = F.raise_error(F.lit("cluster labels are missing on rows that are tested")).cast("string")
        picked.append(F.when(ok, F.coalesce(as_column(spec.cluster).cast("string"), blank)).alias("__c"))
    return rows.select(*picked, *(as_column(o).alias(f"__o{k}") for k, o in enumerate(spec.order)))


def _side(tag: str, where: Column) -> list[Column]:
    """Count, mean and sum of squared deviations of one side of the comparison."""
    v = F.when(where, F.col("__v"))
    return [F.count(v).alias(f"n{tag}"), F.avg(v).alias(f"m{tag}"), (F.var_pop(v) * F.count(v)).alias(f"q{tag}")]


def cells(rows: DataFrame, spec: StatSpec, by: Sequence[str]) -> DataFrame:
    """Sufficient statistics per group of ``by`` (and cluster): they can be merged into coarser groups by
    ``evaluate_cells`` as often as needed, while the rows are read once."""
    edges = [f(F.when(w, F.col("__v"))).alias(n + t) for t, w in (("1", F.col("__g")), ("0", ~F.col("__g"))) for n, f in (("lo", F.min), ("hi", F.max))]
    keys = [*by, "__c"] if spec.cluster is not None else list(by)
    return _picked(rows, spec, list(by)).groupBy(*keys).agg(F.count("*").alias("n_rows"), *_side("1", F.col("__g")), *_side("0", ~F.col("__g")), *edges)


def evaluate_cells(parts: DataFrame, spec: StatSpec, by: Sequence[str]) -> DataFrame:
    """``evaluate`` from merged cells (no Newey-West): means first, then deviations from them."""
    by = list(by)
    n, s = (lambda t: F.sum(f"n{t}")), (lambda t: F.sum(F.col(f"n{t}") * F.coalesce(f"m{t}", F.lit(0.0))))
    whole = parts.groupBy(*by).agg(
        F.sum("n_rows").alias("all_rows"),
        *(c for t in "10" for c in (n(t).alias(f"N{t}_"), (s(t) / F.when(n(t) > 0, n(t))).alias(f"M{t}_"), (F.min(f"lo{t}") < F.max(f"hi{t}")).alias(f"V{t}_"))),
    )
    gap = lambda t: F.coalesce(F.col(f"q{t}"), F.lit(0.0)) + F.coalesce(F.col(f"n{t}") * F.pow(F.col(f"m{t}") - F.col(f"M{t}_"), F.lit(2.0)), F.lit(0.0))
    spread = parts.join(whole, by).groupBy(*by).agg(*(F.sum(F.when(F.col(f"V{t}_"), gap(t)).otherwise(0.0)).alias(f"q{t}") for t in "10"))
    base = whole.join(spread, by).select(*by, F.col("all_rows").alias("n_rows"), *(c for t in "10" for c in (F.col(f"N{t}_").alias(f"n{t}"), F.col(f"M{t}_").alias(f"m{t}"), f"q{t}")))
    sums = None
    if spec.cluster is not None:
        sums = parts.where("n1 + n0 > 0").groupBy(*by, "__c").agg(s("1").alias("s1"), n("1").alias("k1"), s("0").alias("s0"), n("0").alias("k0"))
    return _finish(_with_model(base, spec), spec, by, None, sums)


def _with_model(base: DataFrame, spec: StatSpec) -> DataFrame:
    n, n1, n0 = F.col("n1") + F.col("n0"), F.col("n1"), F.col("n0")
    if spec.group is not None:
        coef, sxx, usable, share = F.col("m1") - F.col("m0"), n1 * n0 / F.when(n > 0, n), (n1 >= 2) & (n0 >= 2), n1 / F.when(n > 0, n)
    else:
        coef, sxx, usable, share = F.col("m1"), n1.cast("double"), n >= 2, F.lit(0.0)
    rss = F.coalesce("q1", F.lit(0.0)) + F.coalesce("q0", F.lit(0.0))
    if spec.group is not None:  # equal constants on both sides differ by nothing, whatever the sums round to
        same = (rss == 0) & (F.abs(coef) <= 1e-13 * (F.abs("m1") + F.abs("m0")))
        coef = F.when(same, F.lit(0.0)).otherwise(coef)
    return base.withColumns({"__n": n, "__coef": coef, "__sxx": sxx, "__share": share, "__rss": rss, "__ok": usable})


def _finish(base: DataFrame, spec: StatSpec, by: list[str], hac: DataFrame | None, sums: DataFrame | None) -> DataFrame:
    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, by, "left") if by else left.crossJoin(right)

    variance = F.when(F.col("__n") > spec.parameters, F.col("__rss") / (F.col("__n") - spec.parameters) / F.when(F.col("__sxx") != 0, F.col("__sxx")))
    clusters, dof = F.lit(None).cast("bigint"), (F.col("__n") - spec.parameters).cast("double")
    out = base
    if hac is not None:
        out, variance = joined(out, hac), F.greatest(F.col("__hac"), F.lit(0.0))
    if sums is not None:
        means = base.select(*by, "m1", "m0", "__share")
        with_means = sums.join(means, by) if by else sums.crossJoin(F.broadcast(means))
        one = F.coalesce("s1", F.lit(0.0)) - F.coalesce("m1", F.lit(0.0)) * F.col("k1")
        two = F.coalesce("s0", F.lit(0.0)) - F.coalesce("m0", F.lit(0.0)) * F.col("k0")
        score = (1 - F.col("__share")) * one - F.col("__share") * two
        out = joined(out, with_means.groupBy(*by).agg(F.sum(score * score).alias("__meat"), F.count("*").alias("__g_n")))
        g, nn = F.coalesce("__g_n", F.lit(0)), F.col("__n")
        robust = g / F.when(g > 1, g - 1) * (nn - 1) / F.when(nn > spec.parameters, nn - spec.parameters) * F.col("__meat") / (F.col("__sxx") * F.col("__sxx"))
        variance = F.when(g >= 2, robust).otherwise(variance)
        clusters, dof = g.cast("bigint"), F.when(g >= 2, (g - 1).cast("double")).otherwise(dof)
    se = F.when(F.col("__rss") == 0, F.lit(0.0)).otherwise(F.sqrt(variance))
    mean = F.when(F.col("__ok") if spec.group is not None else F.col("__n") >= 1, F.col("__coef"))
    t = F.when(F.col("__ok"), ratio(F.col("__coef"), se))
    result = out.select(
        *by, "n_rows", mean.alias("mean"), t.alias("t_stat"), F.col("__n").cast("bigint").alias("n"),
        F.when(F.col("__ok"), clusters).alias("n_clusters"), F.when(F.col("__ok"), dof).alias("df"),
    )
    return result.withColumn("significant", significant(F.col("t_stat"), F.col("df"), spec.significance_t)).select(*by, *STAT_FIELDS, "n_rows")


def _lag_products(data: DataFrame, base: DataFrame, spec: StatSpec, by: list[str]) -> DataFrame:
    """Bartlett-weighted sum of influence products per group."""
    side = base.select(*by, "m1", "m0", "__share", "__sxx")
    rows = data.where("__v is not null")
    rows = rows.join(side, by) if by else rows.crossJoin(F.broadcast(side))
    psi = F.when(F.col("__g"), (1 - F.col("__share")) * (F.col("__v") - F.col("m1"))).otherwise(-F.col("__share") * (F.col("__v") - F.col("m0")))
    order = W.partitionBy(*by).orderBy(*(F.col(f"__o{k}") for k in range(len(spec.order))), "__v")
    rows = rows.withColumn("__p", psi / F.col("__sxx"))
    terms = F.col("__p") * F.col("__p")
    for lag in range(1, spec.maxlags + 1):
        weight = 2 * (1 - lag / (spec.maxlags + 1))
        terms = terms + F.lit(weight) * F.coalesce(F.col("__p") * F.lag("__p", lag).over(order), F.lit(0.0))
    return rows.withColumn("__t", terms).groupBy(*by).agg(F.sum("__t").alias("__hac"))


def with_labels(rows: DataFrame, labels: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """``rows`` with the column ``name`` of another frame, matched by the columns ``on`` (null matches null).

    Every row must be matched exactly once: missing or repeated labels raise ValueError (two aggregations).
    """
    on = list(on)
    side = labels.select(*(F.col(c).alias(f"__on{k}") for k, c in enumerate(on)), F.col(name).alias("__label"), F.lit(True).alias("__there"))
    if not side.groupBy(*(f"__on{k}" for k in range(len(on)))).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"{name} has several labels for one of {on}")
    match = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__on{k}")) for k, c in enumerate(on)))
    joined = rows.drop(name).join(side, match, "left")
    missing = joined.where("__there is null").count()
    if missing:
        raise ValueError(f"{name} has no label for {missing} rows")
    return joined.select(*(c for c in rows.columns if c != name), F.col("__label").alias(name))


def as_struct() -> Column:
    return F.struct(*STAT_FIELDS)


def to_result(row) -> StatResult:
    return StatResult(*(row[f] for f in STAT_FIELDS))


def _single(df: DataFrame, spec: StatSpec) -> StatResult:
    if spec.cluster is not None:
        ok = finite(spec.value) & (finite(as_column(spec.group).cast("double")) if spec.group is not None else F.lit(True))
        if df.where(ok & as_column(spec.cluster).isNull()).limit(1).count():
            raise ValueError("cluster labels are missing on rows that are tested")
    return to_result(evaluate(df, spec).first())


def stat_vs_zero(df: DataFrame, value, order=(), maxlags=None, cluster_groups=None, significance_t=None) -> StatResult:
    """t test of the mean of a column against zero."""
    return _single(df, vs_zero(value, cluster_groups, maxlags, order, significance_t))


def stat_group_diff(df: DataFrame, value, group_bool, order=(), maxlags=None, cluster_groups=None, significance_t=None) -> StatResult:
    """t test of the difference of a column's means between two groups."""
    return _single(df, group_diff(value, group_bool, cluster_groups, maxlags, order, significance_t))


def evaluate_callable(rows: DataFrame, fn: Callable, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A caller's own statistic: ``fn`` takes a pandas frame (sorted by ``order``) and returns a StatResult or
    anything with its fields.  One pandas frame per group of ``by``."""
    import pandas as pd

    by = list(by)
    names = [f for f in rows.columns if f not in by]

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        got = fn(frame.sort_values(list(order), kind="stable")[names].reset_index(drop=True))
        row = {f: getattr(got, f, None) for f in STAT_FIELDS}
        return pd.DataFrame([{**{b: frame[b].iloc[0] for b in by}, **row, "n_rows": len(frame)}])

    keys = ", ".join(f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by)
    out = rows.groupBy(*by).applyInPandas(one, f"{keys}, {STAT_SCHEMA}, n_rows bigint")
    nul = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select(*by, nul("mean"), nul("t_stat"), "n", F.coalesce("significant", F.lit(False)).alias("significant"), "n_clusters", nul("df"), "n_rows")


def with_significance(stat: StatResult, significance_t: float | None = None) -> StatResult:
    from ..functions.student import critical_value

    df = stat.df if stat.df is not None else stat.n - 1
    bound = significance_t if significance_t is not None else critical_value(df)
    return replace(stat, significant=stat.t_stat is not None and abs(stat.t_stat) >= bound)
