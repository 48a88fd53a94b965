"""Combinatorial purged cross-validation as one grouped plan.

Groups, paths and roles are functions of the date: the histogram of dates meets the table of paths (a
broadcast of combinations), and rows then join the roles of their date; one aggregation by (path, role)
evaluates every path.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from .stats import STAT_FIELDS, StatResult, StatSpec, cells, evaluate, evaluate_callable, evaluate_cells, to_result
from .timeline import KEY, date_key, date_sort_key, histogram, shifted, snapped
from .verdict import classify


@dataclass(frozen=True)
class CPCVPathResult:
    test_groups: frozenset[int]
    train: StatResult
    test: StatResult
    retention_ratio: float | None
    sign_flipped: bool
    verdict: str


@dataclass(frozen=True)
class CPCVResult:
    n_groups: int
    n_test_groups: int
    paths: list[CPCVPathResult] = field(default_factory=list)
    n_splits_skipped: int = 0
    pct_paths_robust_or_moderate: float | None = None
    median_retention: float | None = None
    overall_verdict: str = K.INSUFFICIENT_DATA
    reasoning: str = ""


def date_groups(keyed: DataFrame, n_groups: int) -> DataFrame:
    """key, n, gid: dates in row-balanced groups (possibly fewer than asked for)."""
    hist = histogram(keyed)
    if n_groups < 2:
        return hist.select(KEY, "n", F.lit(0).alias("gid")).where("false")
    total = F.col("total")
    asked = F.least(F.lit(n_groups).cast("long"), total)
    ideal = F.transform(F.sequence(F.lit(1), F.lit(n_groups - 1)), lambda i: F.when(i < asked, F.least(F.greatest(F.bround(total * i / asked, 0).cast("long"), F.lit(1)), total - 1)))
    inside = F.filter(ideal, lambda c: (c >= F.col("run_start")) & (c < F.col("run_end")))
    cuts = F.filter(F.transform(inside, snapped), lambda c: (c > 0) & (c < total))
    everything = F.array_distinct(F.flatten(F.collect_list(cuts).over(W.partitionBy())))
    marked = hist.withColumn("cuts", everything)
    return marked.select(KEY, "n", F.size(F.filter("cuts", lambda c: c <= F.col("run_start"))).alias("gid"))


def assign_groups(df: DataFrame, date_col: str, n_groups: int) -> DataFrame:
    """df with a column gid."""
    keyed = df.withColumn(KEY, date_key(df, date_col))
    return keyed.join(F.broadcast(date_groups(keyed, n_groups).select(KEY, "gid")), KEY).select(*df.columns, "gid")


def generate_cpcv_splits(n_groups: int, n_test_groups: int):
    """(train groups, test groups) of every combination."""
    every = frozenset(range(n_groups))
    for test in combinations(range(n_groups), n_test_groups):
        yield every - frozenset(test), frozenset(test)


def split_table(gids: DataFrame, n_test_groups: int) -> DataFrame:
    """test_groups: every combination of the group ids of a table (a column gid), as sorted arrays."""
    one = gids.select(F.col("gid").cast("int").alias("gid")).distinct()
    out = one.select(F.array("gid").alias("test_groups"))
    for _ in range(n_test_groups - 1):
        out = out.join(F.broadcast(one), F.element_at("test_groups", -1) < F.col("gid")).select(F.concat("test_groups", F.array("gid")).alias("test_groups"))
    return out


def contiguous_runs(paths: DataFrame) -> DataFrame:
    """test_groups, run_first, run_last of each stretch of neighbouring groups (gaps and islands)."""
    each = paths.select("test_groups", F.posexplode("test_groups").alias("pos", "gid"))
    return each.groupBy("test_groups", (F.col("gid") - F.col("pos")).alias("island")).agg(F.min("gid").alias("run_first"), F.max("gid").alias("run_last")).drop("island")


def date_roles(groups: DataFrame, n_test_groups: int, purge_days: float = 0, embargo_days: float = 0) -> DataFrame:
    """test_groups, key, n, role (train, test, purged, embargoed) of every path and date.

    A date removed by several held-out runs counts for the first of them.
    """
    kind = groups.schema[KEY].dataType
    purge, embargo = max(purge_days, 0), max(embargo_days, 0)
    span = groups.groupBy("gid").agg(F.min(KEY).alias("first"), F.max(KEY).alias("last"))
    runs = contiguous_runs(split_table(groups, n_test_groups))
    lo = span.select(F.col("gid").alias("run_first"), "first")
    hi = span.select(F.col("gid").alias("run_last"), "last")
    runs = runs.join(F.broadcast(lo), "run_first").join(F.broadcast(hi), "run_last")
    paths = runs.groupBy("test_groups").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))
    key = F.col(KEY)

    def hit(run):
        first, last = run["first"], run["last"]
        before = (key < first) & (key >= shifted(first, kind, -purge)) if purge else F.lit(False)
        after = (key > last) & (key <= shifted(last, kind, purge)) if purge else F.lit(False)
        late = (key > shifted(last, kind, purge)) & (key <= shifted(last, kind, purge + embargo)) if embargo else F.lit(False)
        return F.when(before | after, "purged").when(late, "embargoed")

    hits = F.filter(F.transform("runs", hit), lambda r: r.isNotNull())
    head = F.exists("runs", lambda r: (key >= r["first"]) & (key <= r["last"]) & (key < shifted(r["first"], kind, embargo))) if embargo else F.lit(False)
    role = F.when(F.array_contains("test_groups", F.col("gid")), F.when(head, "embargoed").otherwise("test")).otherwise(F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit("train")))
    return groups.crossJoin(F.broadcast(paths)).select("test_groups", KEY, "n", role.alias("role"))


def build_split_frames(df: DataFrame, date_col: str, n_groups: int, test_groups, purge_days: float = 0, embargo_days: float = 0):
    """(train, test, n_purged, n_embargoed) of one path."""
    keyed = date_sort_key(df, date_col)
    wanted = F.array(*(F.lit(int(g)) for g in sorted(test_groups)))
    plan = date_roles(date_groups(keyed, n_groups), len(set(test_groups)), purge_days, embargo_days).where(F.col("test_groups") == wanted)
    counts = {r["role"]: r["n"] for r in plan.groupBy("role").agg(F.sum("n").alias("n")).collect()}
    rows = keyed.join(F.broadcast(plan.select(KEY, "role")), KEY)
    frames = (rows.where(F.col("role") == r).orderBy(KEY).select(*df.columns) for r in ("train", "test"))
    return *frames, counts.get("purged", 0), counts.get("embargoed", 0)


def cpcv_paths(
    df: DataFrame, date_col: str, stat: StatSpec | Callable, n_groups: int = K.DEFAULT_N_GROUPS, n_test_groups: int = K.DEFAULT_N_TEST_GROUPS, purge_days: float = 0,
    embargo_days: float = 0, min_n_per_split: int = K.DEFAULT_MIN_N_PER_SPLIT, significance_t: float | None = None,
) -> DataFrame:
    """One row per combination: test_groups, n_train, n_test, skipped, train, test, retention_ratio,
    sign_flipped, verdict, reasoning."""
    keyed = df.withColumn(KEY, date_key(df, date_col))
    plan = date_roles(date_groups(keyed, n_groups), n_test_groups, purge_days, embargo_days)
    sides = F.sum(F.when(F.col("role") == "train", F.col("n")).otherwise(0)), F.sum(F.when(F.col("role") == "test", F.col("n")).otherwise(0))
    counts = plan.groupBy("test_groups").agg(sides[0].alias("n_train"), sides[1].alias("n_test"))
    short = (F.col("n_train") < min_n_per_split) | (F.col("n_test") < min_n_per_split)
    # the paths and roles of a date travel as one list, so that each row meets its date once
    listed = plan.where("role in ('train', 'test')").groupBy(KEY).agg(F.collect_list(F.struct("test_groups", "role")).alias("uses"))
    by = ["test_groups", "role"]

    def used(dated: DataFrame) -> DataFrame:
        each = dated.join(listed, KEY).withColumn("use", F.explode("uses")).drop("uses")
        return each.withColumns({"test_groups": F.col("use.test_groups"), "role": F.col("use.role")}).drop("use")

    if isinstance(stat, StatSpec) and stat.maxlags is None:  # rows are read once; dates are merged into paths
        stats = evaluate_cells(used(cells(keyed, stat, [KEY])), stat, by)
    elif isinstance(stat, StatSpec):
        stats = evaluate(used(keyed), stat, by)
    else:
        stats = evaluate_callable(used(keyed).select(*by, *df.columns), stat, by, [date_col])
    pick = lambda r: F.max(F.when(F.col("role") == r, F.struct(*STAT_FIELDS))).alias(r)
    both = counts.join(stats.groupBy("test_groups").agg(pick("train"), pick("test")), "test_groups", "left").withColumn("skipped", short)
    both = both.withColumn("c", F.when(~F.col("skipped"), classify(F.col("train"), F.col("test"), significance_t)))
    return both.select("test_groups", "n_train", "n_test", "skipped", "train", "test", "c.retention_ratio", "c.sign_flipped", "c.verdict", "c.reasoning")


def overall(paths: DataFrame, pct_for_robust: float = K.DEFAULT_PCT_ROBUST_FOR_ROBUST, pct_for_moderate: float = K.DEFAULT_PCT_ROBUST_FOR_MODERATE) -> DataFrame:
    """One row: n_paths, n_splits_skipped, pct_paths_robust_or_moderate, median_retention, overall_verdict,
    reasoning of the path table of ``cpcv_paths``."""
    told = F.coalesce(~F.col("verdict").isin(K.INSUFFICIENT_DATA, K.INSUFFICIENT_INSAMPLE_EDGE), F.lit(False))
    low = F.least(F.col("train.n_clusters"), F.col("test.n_clusters"))
    used = F.coalesce(~F.col("skipped"), F.lit(True))
    agg = paths.agg(
        F.count_if(used).alias("n_paths"), F.count_if(~used).alias("n_splits_skipped"), F.count_if(told).alias("told"),
        F.count_if(F.col("verdict").isin(K.ROBUST, K.MODERATE)).alias("good"), F.count_if(F.col("verdict") == K.OVERFITTED).alias("bad"),
        F.median("retention_ratio").alias("median_retention"),
        F.count_if(used & (low < K.MIN_RELIABLE_CLUSTERS)).alias("low"), F.min(F.when(used, low)).alias("least"),
    )
    pct = F.when(F.col("told") > 0, F.col("good") / F.when(F.col("told") > 0, F.col("told")))
    verdict = (
        F.when(pct.isNull(), K.INSUFFICIENT_DATA).when(pct >= pct_for_robust, K.ROBUST).when(pct >= pct_for_moderate, K.MODERATE)
        .when(F.col("bad") / F.greatest(F.col("told"), F.lit(1)) >= 1 - pct_for_moderate, K.OVERFITTED).otherwise(K.WEAK)
    )
    share = F.format_string("%d of %d informative paths are robust or moderate", "good", "told")
    why = F.when(F.col("n_paths") == 0, F.format_string("all %d splits are too small to evaluate", "n_splits_skipped")).when(pct.isNull(), F.lit("no path has an edge and enough data to judge")).otherwise(share)
    skipped = F.when((F.col("n_splits_skipped") > 0) & (F.col("n_paths") > 0), F.format_string(" (%d splits skipped)", "n_splits_skipped")).otherwise("")
    caveat = F.when(F.col("low") > 0, F.format_string(f" CAVEAT: %d paths have fewer than {K.MIN_RELIABLE_CLUSTERS} clusters (at least %d); treat the verdict as inconclusive", "low", "least")).otherwise("")
    return agg.select("n_paths", "n_splits_skipped", pct.alias("pct_paths_robust_or_moderate"), "median_retention", verdict.alias("overall_verdict"), F.concat(why, skipped, caveat).alias("reasoning"))


def classify_cpcv_overall(path_verdicts: list[str], pct_for_robust: float = K.DEFAULT_PCT_ROBUST_FOR_ROBUST, pct_for_moderate: float = K.DEFAULT_PCT_ROBUST_FOR_MODERATE):
    """(verdict, reasoning, share) of a list of path verdicts."""
    stat = "struct<n_clusters:bigint>"
    rows = [(v, False, None, None, None) for v in path_verdicts]
    df = SparkSession.getActiveSession().createDataFrame(rows, f"verdict string, skipped boolean, retention_ratio double, train {stat}, test {stat}")
    row = overall(df, pct_for_robust, pct_for_moderate).first()
    return row["overall_verdict"], row["reasoning"], row["pct_paths_robust_or_moderate"]


def cpcv_validate(
    df: DataFrame, date_col: str, stat_fn: StatSpec | Callable, n_groups: int = K.DEFAULT_N_GROUPS, n_test_groups: int = K.DEFAULT_N_TEST_GROUPS, **options
) -> CPCVResult:
    """Every purged combination evaluated, as a record (the path table is small: one row per combination)."""
    if n_groups < 2 or n_test_groups < 1 or n_test_groups >= n_groups or df.isEmpty():
        return CPCVResult(n_groups, n_test_groups, reasoning="nothing to evaluate: no rows, or an invalid number of groups")
    keyed = date_sort_key(df, date_col)
    actual = date_groups(keyed, n_groups).agg(F.count_distinct("gid").alias("g")).first()["g"]
    if actual < 2 or n_test_groups >= actual:
        return CPCVResult(n_groups, n_test_groups, reasoning=f"only {actual} groups could be formed, too few to hold out {n_test_groups}")
    paths = cpcv_paths(df, date_col, stat_fn, n_groups, n_test_groups, **options)
    rows = sorted(paths.collect(), key=lambda r: r["test_groups"])
    total = overall(df.sparkSession.createDataFrame(rows, paths.schema)).first()
    records = [
        CPCVPathResult(frozenset(r["test_groups"]), to_result(r["train"]), to_result(r["test"]), r["retention_ratio"], r["sign_flipped"], r["verdict"])
        for r in rows if not r["skipped"]
    ]
    return CPCVResult(actual, n_test_groups, records, total["n_splits_skipped"], total["pct_paths_robust_or_moderate"], total["median_retention"], total["overall_verdict"], total["reasoning"])


def _share(result: CPCVResult) -> str:
    p = result.pct_paths_robust_or_moderate
    return "n/a" if p is None else f"{p * 100:.0f}%"


# Fixed formats of the two summary lines.
_PRINT_LINE = "    [CPCV check] {paths} path(s) evaluated ({skipped} skipped) -> {verdict} ({share} of paths ROBUST/MODERATE)"
_REGISTRY_NOTE = " CPCV ({n} groups, C({n},{k})={total} paths): {verdict} ({share} of {paths} evaluated path(s) ROBUST/MODERATE)."


def _facts(result: CPCVResult) -> dict:
    done = len(result.paths)
    return {
        "paths": done, "skipped": result.n_splits_skipped, "total": done + result.n_splits_skipped, "verdict": result.overall_verdict,
        "share": _share(result), "n": result.n_groups, "k": result.n_test_groups,
    }


def format_cpcv_print_line(result: CPCVResult) -> str:
    return _PRINT_LINE.format(**_facts(result))


def format_cpcv_registry_note(result: CPCVResult) -> str:
    return _REGISTRY_NOTE.format(**_facts(result))
