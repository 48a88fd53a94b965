"""Registered queries of the validation operators, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohort, cpcv, multiple, stats, timeline, verdict
from ..operators.walk_forward import walk_forward
from ..sources import store
from . import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(name: str, sql: str | None, build: Query) -> None:
    QUERIES[name] = build
    if sql:
        ORACLE_SQL[name] = sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, offset: float = 45) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.to_date("ts").alias("d"), "ts", "event_id", "user_id", "event_type", (F.col("value") - offset).alias("x"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.year("o_orderdate").alias("cohort"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("z"), (F.col("l_returnflag") == "R").alias("g")
    )


def r6(c: str | Column, name: str | None = None, digits: int = 6) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, digits).alias(name or c)


# ---- splits

def _split_counts(source: DataFrame, purge: int = 0, embargo: int = 0) -> DataFrame:
    keyed = source.withColumn(timeline.KEY, timeline.date_key(source, "d"))
    marked = timeline.roles(keyed, timeline.split_bounds(keyed), purge, embargo)
    return marked.groupBy("role").agg(F.count("*").alias("n"), F.min("d").cast("string").alias("first_day"), F.max("d").cast("string").alias("last_day"))


def _ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d"))


_COUNTS = "SELECT role, count(*) AS n, CAST(min(d) AS VARCHAR) AS first_day, CAST(max(d) AS VARCHAR) AS last_day FROM r GROUP BY role"
_DAYS = oracle.EVENTS.format(offset=45)
_SHIP = "SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem"
registered("chrono_split_counts", f"WITH {oracle.split_days(_DAYS, 0.7)}, {oracle.roles(0, 0)} {_COUNTS}", lambda s, d: _split_counts(events(s, d)))
registered("chrono_split_tied_snap", f"WITH {oracle.split_days(_SHIP, 0.7)}, {oracle.roles(0, 0)} {_COUNTS}", lambda s, d: _split_counts(_ship(s, d)))
registered("purge_embargo_counts", f"WITH {oracle.split_days(_DAYS, 0.7)}, {oracle.roles(2, 1)} {_COUNTS}", lambda s, d: _split_counts(events(s, d), 2, 1))


# ---- statistics

def _stat(rows: DataFrame, spec: stats.StatSpec) -> DataFrame:
    return stats.evaluate(rows, spec).select(r6("mean"), r6("t_stat"), "n", "n_clusters", "df", "significant")


def _shown(inner: str, clusters: str = "CAST(NULL AS BIGINT)") -> str:
    return f"SELECT round(m, 6) AS mean, round(t, 6) AS t_stat, CAST(n AS BIGINT) AS n, {clusters} AS n_clusters, df, {oracle.significant('t', 'df')} AS significant FROM ({inner})"


_ONE = f"WITH r AS (SELECT *, 1 AS one FROM ({_DAYS}))"
registered("stat_vs_zero_plain", f"{_ONE} {_shown(oracle.plain_stats('one'))}", lambda s, d: _stat(events(s, d), stats.vs_zero("x")))
registered("stat_vs_zero_cluster", f"{_ONE} {_shown(oracle.cluster_stats('one'), 'CAST(g AS BIGINT)')}", lambda s, d: _stat(events(s, d), stats.vs_zero("x", cluster="user_id")))
registered(
    "stat_vs_zero_hac",
    f"""WITH s AS (SELECT d, avg(x) AS x FROM ({_DAYS}) GROUP BY d), a AS (SELECT *, (x - avg(x) OVER ()) / count(*) OVER () AS p FROM s),
    l AS (SELECT *, lag(p, 1) OVER o AS p1, lag(p, 2) OVER o AS p2, lag(p, 3) OVER o AS p3 FROM a WINDOW o AS (ORDER BY d))
    {_shown("SELECT avg(x) AS m, avg(x) / sqrt(sum(p * p) + 1.5::DOUBLE * sum(p * p1) + 1.0::DOUBLE * sum(p * p2) + 0.5::DOUBLE * sum(p * p3)) AS t, count(*) AS n, CAST(count(*) - 1 AS DOUBLE) AS df FROM l")}""",
    lambda s, d: _stat(events(s, d).groupBy("d").agg(F.avg("x").alias("x")), stats.vs_zero("x", maxlags=3, order=["d"])),
)


def _bought() -> Column:
    return F.col("event_type") == "purchase"


_PSI = f"""WITH e AS (SELECT *, event_type = 'purchase' AS g FROM ({_DAYS})),
    a AS (SELECT avg(x) FILTER (g) AS m1, avg(x) FILTER (NOT g) AS m0, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n0, count(*)::DOUBLE AS n, var_pop(x) FILTER (g) AS v1, var_pop(x) FILTER (NOT g) AS v0 FROM e),
    i AS (SELECT e.*, n, m1 - m0 AS m, CASE WHEN g THEN (1 - n1 / n) * (x - m1) ELSE -(n1 / n) * (x - m0) END / (n1 * n0 / n) AS p FROM e, a)"""
registered(
    "stat_group_diff_plain",
    f"{_PSI} {_shown('SELECT m1 - m0 AS m, (m1 - m0) / sqrt((v1 * n1 + v0 * n0) / (n - 2) / (n1 * n0 / n)) AS t, n, n - 2 AS df FROM a')}",
    lambda s, d: _stat(events(s, d), stats.group_diff("x", _bought())),
)
registered(
    "stat_group_diff_cluster",
    f"""{_PSI}, c AS (SELECT user_id, sum(p) AS p, count(*) AS k, any_value(m) AS m FROM i GROUP BY user_id)
    {_shown("SELECT any_value(m) AS m, any_value(m) / sqrt(count(*)::DOUBLE / (count(*) - 1) * (sum(k) - 1) / (sum(k) - 2) * sum(p * p)) AS t, sum(k) AS n, CAST(count(*) - 1 AS DOUBLE) AS df, count(*) AS g FROM c", "CAST(g AS BIGINT)")}""",
    lambda s, d: _stat(events(s, d), stats.group_diff("x", _bought(), cluster="user_id")),
)
registered(
    "stat_group_diff_hac",
    f"""{_PSI}, l AS (SELECT *, lag(p, 1) OVER o AS p1, lag(p, 2) OVER o AS p2 FROM i WINDOW o AS (PARTITION BY 1 ORDER BY ts, event_id))
    {_shown("SELECT any_value(m) AS m, any_value(m) / sqrt(sum(p * p) + (4.0::DOUBLE / 3) * sum(p * p1) + (2.0::DOUBLE / 3) * sum(p * p2)) AS t, count(*) AS n, CAST(count(*) - 2 AS DOUBLE) AS df FROM l")}""",
    lambda s, d: _stat(events(s, d), stats.group_diff("x", _bought(), maxlags=2, order=["ts", "event_id"])),
)
registered(
    "student_p_values",
    f"""WITH t AS (SELECT unnest([0.1, 0.5, 1.0, 1.96, 2.5, 4.0, 8.0])::DOUBLE AS t), v AS (SELECT unnest([1, 2, 3, 7, 8, 30, 149, 200, 250, 900, 5000])::DOUBLE AS nu)
    SELECT t, nu, round({oracle.p_value('t', 'nu')}, 8) AS p_value FROM t, v""",
    lambda s, d: _student_grid(s),
)


def _student_grid(spark: SparkSession) -> DataFrame:
    from ..functions.student import two_sided_p

    t = spark.createDataFrame([(x,) for x in (0.1, 0.5, 1.0, 1.96, 2.5, 4.0, 8.0)], "t double")
    nu = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 7, 8, 30, 149, 200, 250, 900, 5000)], "nu double")
    return t.crossJoin(F.broadcast(nu)).select("t", "nu", r6(two_sided_p(F.col("t"), F.col("nu")), "p_value", 8))


# ---- walk-forward

def _walk(spark: SparkSession, sf_dir: str, offset: float = 45, spec: stats.StatSpec | None = None, **options) -> DataFrame:
    w = walk_forward(events(spark, sf_dir, offset), "d", spec or stats.vs_zero("x"), **options)
    return w.select(
        "verdict", F.col("train.n").alias("n_train"), F.col("test.n").alias("n_test"), r6("train.mean", "train_mean"), r6("test.mean", "test_mean"), r6("train.t_stat", "train_t"),
        r6("test.t_stat", "test_t"), r6("retention_ratio"), "sign_flipped", "n_purged_train", "n_embargoed_test",
    )


registered("walk_forward_verdict", oracle.walk_forward(45), lambda s, d: _walk(s, d))
registered("walk_forward_no_edge", oracle.walk_forward(50), lambda s, d: _walk(s, d, 50))
registered("walk_forward_strong", oracle.walk_forward(0), lambda s, d: _walk(s, d, 0))
registered("walk_forward_purged", oracle.walk_forward(45, 2, 1), lambda s, d: _walk(s, d, purge_days=2, embargo_days=1))
registered("walk_forward_fixed_t", oracle.walk_forward(45, fixed=12.0), lambda s, d: _walk(s, d, significance_t=12.0))
registered("walk_forward_insufficient", oracle.walk_forward(45, min_n=10_000_000), lambda s, d: _walk(s, d, min_n_per_split=10_000_000))
registered("walk_forward_cluster", oracle.walk_forward(45, 2, 1, cluster=True), lambda s, d: _walk(s, d, 45, stats.vs_zero("x", cluster="user_id"), purge_days=2, embargo_days=1))

_TRAIN = [(1.0, 5.0), (1.0, 1.0), (-2.0, -4.0), (0.0, 3.0), (2.0, 1e12)]
_TEST = [(0.7, 3.0), (0.4, 3.0), (0.35, 2.5), (0.2, 2.5), (0.2, 0.5), (0.5, 0.5), (-0.5, -3.0), (-1.5, -3.0), (None, None), (1.0, None)]


def _grid(spark: SparkSession) -> DataFrame:
    kind = "struct<mean:double,t_stat:double,n:bigint,significant:boolean,n_clusters:bigint,df:double>"
    train = spark.createDataFrame([((m, t, 40, False, None, 39.0),) for m, t in _TRAIN], f"train {kind}")
    test = spark.createDataFrame([((m, t, 20, False, None, None),) for m, t in _TEST], f"test {kind}")
    c = train.crossJoin(F.broadcast(test)).withColumn("c", verdict.classify(F.col("train"), F.col("test")))
    return c.select(F.col("train.mean").alias("m1"), F.col("train.t_stat").alias("t1"), F.col("test.mean").alias("m2"), F.col("test.t_stat").alias("t2"), "c.verdict", r6("c.retention_ratio", "retention_ratio"), "c.sign_flipped")


def _values(rows: list) -> str:
    text = lambda x: "NULL" if x is None else "'inf'::DOUBLE" if x == float("inf") else f"{x}::DOUBLE"
    return ", ".join(f"({text(m)}, {text(t)})" for m, t in rows)


registered(
    "classify_overfitting_grid",
    f"""WITH g AS (SELECT *, 39::DOUBLE AS df1, 19::DOUBLE AS df2 FROM (VALUES {_values(_TRAIN)}) a(m1, t1), (VALUES {_values(_TEST)}) b(m2, t2)), v AS (SELECT *, {oracle.verdict()} AS verdict FROM g)
    SELECT m1, t1, m2, t2, verdict, CASE WHEN verdict NOT LIKE 'INSUFFICIENT%' AND m1 <> 0 THEN round(m2 / m1, 6) END AS retention_ratio, verdict = 'OVERFITTED' AND sign(m1) * sign(m2) < 0 AS sign_flipped FROM v""",
    lambda s, d: _grid(s),
)


# ---- combinatorial validation

def _groups(source: DataFrame, n: int) -> DataFrame:
    keyed = source.withColumn(timeline.KEY, timeline.date_key(source, "d"))
    return cpcv.date_groups(keyed, n)


def _group_sizes(source: DataFrame, n: int) -> DataFrame:
    g = _groups(source, n)
    return g.groupBy(F.col("gid").cast("long").alias("gid")).agg(F.sum("n").alias("n"), F.min(timeline.KEY).cast("date").cast("string").alias("first_day"), F.max(timeline.KEY).cast("date").cast("string").alias("last_day"))


_SIZES = "SELECT CAST(gid AS BIGINT) AS gid, CAST(sum(n) AS BIGINT) AS n, CAST(min(d) AS VARCHAR) AS first_day, CAST(max(d) AS VARCHAR) AS last_day FROM gr GROUP BY gid"
registered("assign_groups_events", f"WITH {oracle.groups(_DAYS, 6)} {_SIZES}", lambda s, d: _group_sizes(events(s, d), 6))
registered("assign_groups_lineitem", f"WITH {oracle.groups(_SHIP, 7)} {_SIZES}", lambda s, d: _group_sizes(_ship(s, d), 7))


def _splits(spark: SparkSession, n: int, k: int) -> DataFrame:
    return cpcv.split_table(spark.range(n).select(F.col("id").alias("gid")), k)


_IDS = "WITH g AS (SELECT unnest(generate_series(0, 5)) AS gid)"
registered(
    "cpcv_splits",
    f"{_IDS} SELECT a.gid || ',' || b.gid || ',' || c.gid AS test_groups FROM g a JOIN g b ON a.gid < b.gid JOIN g c ON b.gid < c.gid",
    lambda s, d: _splits(s, 6, 3).select(F.concat_ws(",", F.col("test_groups").cast("array<string>")).alias("test_groups")),
)
registered(
    "cpcv_runs",
    f"""{_IDS}, p AS (SELECT a.gid || ',' || b.gid || ',' || c.gid AS test_groups, [a.gid, b.gid, c.gid] AS l FROM g a JOIN g b ON a.gid < b.gid JOIN g c ON b.gid < c.gid),
    e AS (SELECT test_groups, l[i] AS gid, l[i] - i AS island FROM p, LATERAL (SELECT unnest([1, 2, 3]) AS i))
    SELECT test_groups, CAST(min(gid) AS INTEGER) AS run_first, CAST(max(gid) AS INTEGER) AS run_last FROM e GROUP BY test_groups, island""",
    lambda s, d: cpcv.contiguous_runs(_splits(s, 6, 3)).withColumn("test_groups", F.concat_ws(",", F.col("test_groups").cast("array<string>"))),
)


def _path() -> Column:
    return F.concat_ws(",", F.col("test_groups").cast("array<string>")).alias("path")


registered(
    "cpcv_frame_counts",
    f"WITH {oracle.groups(_DAYS, 6)}, {oracle.paths(2, 1)} SELECT path, role, CAST(sum(n) AS BIGINT) AS n FROM rl GROUP BY path, role",
    lambda s, d: cpcv.date_roles(_groups(events(s, d), 6), 2, 2, 1).groupBy(_path(), "role").agg(F.sum("n").alias("n")),
)
_PATH_ROWS = "SELECT path, CAST(n1 AS BIGINT) AS n_train, CAST(n2 AS BIGINT) AS n_test, round(t1, 6) AS train_t, round(t2, 6) AS test_t, CASE WHEN verdict NOT LIKE 'INSUFFICIENT%' THEN round(m2 / m1, 6) END AS retention_ratio, verdict FROM pv"


def _paths(spark: SparkSession, sf_dir: str, offset: float, cluster: str | None = None) -> DataFrame:
    return cpcv.cpcv_paths(events(spark, sf_dir, offset), "d", stats.vs_zero("x", cluster=cluster), purge_days=2, embargo_days=1)


def _path_rows(paths: DataFrame) -> DataFrame:
    return paths.select(_path(), "n_train", "n_test", r6("train.t_stat", "train_t"), r6("test.t_stat", "test_t"), r6("retention_ratio"), "verdict")


registered("cpcv_paths", f"{oracle.cpcv(45)} {_PATH_ROWS}", lambda s, d: _path_rows(_paths(s, d, 45)))
registered("cpcv_paths_cluster", f"{oracle.cpcv(46, True)} {_PATH_ROWS}", lambda s, d: _path_rows(_paths(s, d, 46, "user_id")))
registered(
    "cpcv_overall",
    f"""{oracle.cpcv(47)}, a AS (SELECT count(*) AS n_paths, count(*) FILTER (verdict NOT LIKE 'INSUFFICIENT%') AS told, count(*) FILTER (verdict IN ('ROBUST', 'MODERATE')) AS good,
      count(*) FILTER (verdict = 'OVERFITTED') AS bad, median(CASE WHEN verdict NOT LIKE 'INSUFFICIENT%' THEN m2 / m1 END) AS mr FROM pv)
    SELECT n_paths, 0::BIGINT AS n_splits_skipped, CASE WHEN told > 0 THEN round(good / told::DOUBLE, 6) END AS pct_paths_robust_or_moderate, round(mr, 6) AS median_retention,
      CASE WHEN told = 0 THEN 'INSUFFICIENT_DATA' WHEN good / told::DOUBLE >= 0.7::DOUBLE THEN 'ROBUST' WHEN good / told::DOUBLE >= 0.4::DOUBLE THEN 'MODERATE'
           WHEN bad / told::DOUBLE >= 0.6::DOUBLE THEN 'OVERFITTED' ELSE 'WEAK' END AS overall_verdict FROM a""",
    lambda s, d: cpcv.overall(_paths(s, d, 47)).select("n_paths", "n_splits_skipped", r6("pct_paths_robust_or_moderate"), r6("median_retention"), "overall_verdict"),
)


# ---- cohorts

def _series(estimates: DataFrame, **options) -> DataFrame:
    t = cohort.estimate_test(estimates, **options)
    return t.select(r6("mean_estimate"), r6("std_estimate"), r6("t_stat"), r6("p_value", digits=9), "n_periods", "significant")


_PANEL = f"WITH {oracle.panel()}"
registered(
    "fm_slope_by_cohort", f"{_PANEL} SELECT cohort, round(regr_slope(y, x), 6) AS estimate, count(*) AS n FROM p GROUP BY cohort",
    lambda s, d: cohort.cohort_slopes(panel(s, d), "cohort", "x", "y").select("cohort", r6("estimate"), "n"),
)
registered("fm_slope_summary", f"{_PANEL}, {oracle.series_test(oracle.SLOPES)}", lambda s, d: _series(cohort.cohort_slopes(panel(s, d), "cohort", "x", "y")))
registered("fm_winsorized", f"{_PANEL}, {oracle.series_test(oracle.WINSORIZED)}", lambda s, d: _series(cohort.cohort_slopes(panel(s, d), "cohort", "x", "y", winsorize_x_pct=0.05)))
registered("fm_newey_west", f"{_PANEL}, {oracle.series_test(oracle.SLOPES, 2)}", lambda s, d: _series(cohort.cohort_slopes(panel(s, d), "cohort", "x", "y"), newey_west_lags=2))
registered("fm_group_diff", f"{_PANEL}, {oracle.series_test(oracle.DIFFS)}", lambda s, d: _series(cohort.cohort_group_diffs(panel(s, d), "cohort", "g", "y")))
registered(
    "fm_dropped",
    f"{_PANEL}, c AS (SELECT y, x, CASE WHEN cohort = 1996 THEN NULL WHEN x > 49 THEN 10 * cohort ELSE cohort END AS cohort, CASE WHEN cohort = 1997 THEN 1.0 ELSE x END AS xx FROM p) SELECT CAST(cohort AS INTEGER) AS cohort, count(*) AS n, min(xx) = max(xx) AS dropped FROM c WHERE cohort IS NOT NULL GROUP BY cohort",
    lambda s, d: cohort.cohort_slopes(
        panel(s, d).select("y", F.when(F.col("cohort") == 1997, 1.0).otherwise(F.col("x")).alias("x"), F.when(F.col("cohort") == 1996, None).when(F.col("x") > 49, 10 * F.col("cohort")).otherwise(F.col("cohort")).alias("cohort")),
        "cohort", "x", "y", 1,
    ).select("cohort", "n", "dropped"),
)
registered(
    "fm_multi_slopes", f"{_PANEL} SELECT cohort, x_col, round(estimate, 5) AS estimate FROM ({oracle.MULTI})",
    lambda s, d: cohort.cohort_multi_slopes(panel(s, d), "cohort", ["x", "z"], "y").select("cohort", "x_col", r6("estimate", digits=5)),
)


# ---- corrections

def _p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.student import two_sided_p

    e = table(spark, sf_dir, "events").select("event_type", "user_id", (F.col("value") - 50).alias("v"))
    st = stats.evaluate(e, stats.vs_zero("v"), ["event_type", "user_id"]).where("n >= 3")
    return st.select(F.col("event_type").alias("family"), F.col("user_id").alias("ordinal"), F.col("user_id").cast("string").alias("label"), r6(two_sided_p(F.col("t_stat"), F.col("df")), "p_value", 9))


for _name, _method in (("mcc_bonferroni", "bonferroni"), ("mcc_holm", "holm"), ("mcc_bh", "fdr_bh")):
    registered(_name, oracle.corrected(_method), lambda s, d, m=_method: multiple.correction_summary(_p_values(s, d), alpha=0.2, method=m, family=["family"]))


# ---- keyed store

def _updates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return c, c.where(F.col("turn") % 2 == 0).withColumn("role", F.concat(F.lit("new-"), F.col("role"))).withColumn("seen", F.lit(1))


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _updates(spark, sf_dir)
    both = store.combine(store.with_text_keys(old, ["conv_id", "turn"]), store.with_text_keys(new, ["conv_id", "turn"]))
    return store.dedupe_and_sort(both, ["conv_id", "turn"])


registered(
    "dedup_append_union",
    """WITH c AS (SELECT conv_id, turn, role FROM conversations), k AS (SELECT *, CAST(NULL AS INTEGER) AS seen, 0 AS s FROM c UNION ALL SELECT conv_id, turn, 'new-' || role, 1, 1 FROM c WHERE turn % 2 = 0)
    SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, seen FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY s DESC) AS n FROM k) WHERE n = 1""",
    _appended,
)
registered(
    "dedup_keep_last",
    "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    lambda s, d: store.keep_last(table(s, d, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], F.struct("ts", "event_id")).select("user_id", "event_type", "event_id", r6("value")),
)
registered(
    "dedup_key_normalise",
    """SELECT CAST(CAST(k AS BIGINT) AS VARCHAR) AS k, count(*) AS n FROM (SELECT CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id END AS k FROM events) GROUP BY k""",
    lambda s, d: store.with_text_keys(table(s, d, "events").select(F.when(F.col("user_id") % 7 != 0, F.col("user_id").cast("double")).alias("k")), ["k"]).groupBy("k").agg(F.count("*").alias("n")),
)


def _reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to a CSV store beside the other scratch tables, and what a reload makes of them."""
    import tempfile
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    old, new = _updates(spark, sf_dir)
    role = F.when(F.col("turn") % 5 == 0, "none").when(F.col("turn") % 5 == 2, " NA").otherwise(F.col("role"))
    marked = lambda df: df.withColumn("role", role).withColumn("note", F.when(F.col("turn") % 3 == 0, "N/A").otherwise("none"))
    path = f"{folder.rstrip('/')}/store-{uuid.uuid4().hex}"
    keys = ["conv_id", "turn", "role"]
    store.append_dedup(marked(old), path, keys, verbose=False)
    return store.append_dedup(marked(new), path, keys, verbose=False).select(*keys, "note", F.col("seen").cast("int").alias("seen"))


registered(
    "dedup_csv_round_trip",
    """WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'none' WHEN turn % 5 = 2 THEN ' NA' END AS mark, role, CASE WHEN turn % 3 <> 0 THEN 'none' END AS note FROM conversations),
    k AS (SELECT conv_id, turn, coalesce(mark, role) AS role, note, CAST(NULL AS INTEGER) AS seen, 0 AS s FROM c
      UNION ALL SELECT conv_id, turn, coalesce(mark, 'new-' || role), note, 1, 1 FROM c WHERE turn % 2 = 0)
    SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, note, seen FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, role ORDER BY s DESC) AS n FROM k) WHERE n = 1""",
    _reloaded,
)


# ---- values that are missing or not finite, text dates, callers' statistics, aligned labels

def _odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which some values are null, NaN or infinite."""
    e, v = events(spark, sf_dir), F.col("event_id") % 11
    return e.withColumn("x", F.when(v == 1, None).when(v == 2, float("nan")).when(v == 3, float("inf")).when(v == 4, float("-inf")).otherwise(F.col("x")))


_ODD = f"SELECT * FROM ({_DAYS}) WHERE event_id % 11 NOT IN (1, 2, 3, 4)"
_ODD_ONE = f"WITH r AS (SELECT *, 1 AS one FROM ({_ODD}))"
registered("stat_vs_zero_not_finite", f"{_ODD_ONE} {_shown(oracle.plain_stats('one'))}", lambda s, d: _stat(_odd(s, d), stats.vs_zero("x")))
registered("stat_vs_zero_not_finite_cluster", f"{_ODD_ONE} {_shown(oracle.cluster_stats('one'), 'CAST(g AS BIGINT)')}", lambda s, d: _stat(_odd(s, d), stats.vs_zero("x", cluster="user_id")))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    labels = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("cluster"))
    return stats.with_labels(e.drop("user_id"), labels, ["event_id"], "cluster")


registered("stat_vs_zero_aligned_labels", f"{_ONE} {_shown(oracle.cluster_stats('one'), 'CAST(g AS BIGINT)')}", lambda s, d: _stat(_labelled(s, d), stats.vs_zero("x", cluster="cluster")))


def _text_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.withColumn("d", F.date_format("d", "yyyy-MM-dd"))


registered("chrono_split_text_dates", f"WITH {oracle.split_days(_DAYS, 0.7)}, {oracle.roles(0, 0)} {_COUNTS}", lambda s, d: _split_counts(_text_days(s, d)))


def _mean_and_t(frame) -> stats.StatResult:
    """A statistic as a caller may write it, on a pandas frame."""
    x = frame["x"].to_numpy()
    n, mean = len(x), float(x.mean())
    t = mean / (float(x.std(ddof=1)) / n**0.5)
    return stats.StatResult(mean, t, n, abs(t) >= 2.0, None, float(n - 1))


registered(
    "walk_forward_callers_statistic", oracle.walk_forward(45),
    lambda s, d: walk_forward(events(s, d), "d", _mean_and_t).select(
        "verdict", F.col("train.n").alias("n_train"), F.col("test.n").alias("n_test"), r6("train.mean", "train_mean"), r6("test.mean", "test_mean"), r6("train.t_stat", "train_t"),
        r6("test.t_stat", "test_t"), r6("retention_ratio"), "sign_flipped", "n_purged_train", "n_embargoed_test",
    ),
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward verdict of the events' values less 45, by day."""
    return _walk(spark, sf_dir)
