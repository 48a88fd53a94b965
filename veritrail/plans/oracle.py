"""The registered queries once more, as plain SQL for another engine (independent formulations)."""

from __future__ import annotations

EVENTS = "SELECT CAST(ts AS DATE) AS d, ts, event_id, user_id, event_type, CAST(value AS DOUBLE) - {offset} AS x FROM events"


def p_value(t: str, nu: str) -> str:
    """Two-sided Student tail for whole degrees of freedom, by the finite sums with log-gamma products."""
    cos = f"ln(cos(atan(abs({t}) / sqrt({nu}))))"
    even = f"list_sum([exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1) + 2 * k * {cos}) for k in generate_series(0, CAST({nu} / 2 - 1 AS BIGINT))])"
    odd = f"coalesce(list_sum([exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5) + (2 * k + 1) * {cos}) for k in generate_series(0, CAST(({nu} - 3) / 2 AS BIGINT))]), 0)"
    theta = f"atan(abs({t}) / sqrt({nu}))"
    return (
        f"(CASE WHEN {t} IS NULL OR {nu} IS NULL OR {nu} < 1 THEN NULL WHEN {nu} = 1 THEN 1 - 2 * {theta} / pi() "
        f"WHEN CAST({nu} AS BIGINT) % 2 = 0 THEN 1 - sin({theta}) * {even} ELSE 1 - 2 / pi() * ({theta} + sin({theta}) * {odd}) END)"
    )


def significant(t: str, nu: str, fixed: float | None = None) -> str:
    return f"coalesce(abs({t}) >= {fixed}::DOUBLE, false)" if fixed is not None else f"coalesce({p_value(t, nu)} <= 0.05::DOUBLE, false)"


def split_days(source: str, frac: float) -> str:
    """CTEs: src, h (days), b (test_start)."""
    return f"""
    src AS ({source}),
    h AS (SELECT d, count(*) AS n, sum(count(*)) OVER (ORDER BY d) - count(*) AS s, sum(count(*)) OVER (ORDER BY d) AS e, sum(count(*)) OVER () AS total FROM src GROUP BY d),
    c AS (SELECT max(CASE WHEN s <= trunc(total * {frac}::DOUBLE) AND trunc(total * {frac}::DOUBLE) < e
                          THEN CASE WHEN trunc(total * {frac}::DOUBLE) - s <= e - trunc(total * {frac}::DOUBLE) THEN s ELSE e END END) AS cut_at FROM h),
    b AS (SELECT min(d) AS test_start FROM h, c WHERE s >= cut_at)"""


def roles(purge: int, embargo: int) -> str:
    return f"""
    r AS (SELECT src.*, CASE WHEN d < test_start - INTERVAL {purge} DAY THEN 'train' WHEN d < test_start THEN 'purged'
                             WHEN d < test_start + INTERVAL {embargo} DAY THEN 'embargoed' ELSE 'test' END AS role FROM src, b)"""


def plain_stats(keys: str, rows: str = "r") -> str:
    return f"SELECT {keys}, count(*) AS n, avg(x) AS m, avg(x) / (stddev_samp(x) / sqrt(count(*))) AS t, CAST(count(*) - 1 AS DOUBLE) AS df FROM {rows} GROUP BY {keys}"


def cluster_stats(keys: str, rows: str = "r") -> str:
    return f"""
    SELECT {keys}, sum(k) AS n, any_value(m) AS m, any_value(m) / sqrt(count(*) / (count(*) - 1) * sum((s - m * k) * (s - m * k)) / (sum(k) * sum(k))) AS t, CAST(count(*) - 1 AS DOUBLE) AS df, count(*) AS g
    FROM (SELECT {keys}, user_id, sum(x) AS s, count(*) AS k, sum(sum(x)) OVER (PARTITION BY {keys}) / sum(count(*)) OVER (PARTITION BY {keys}) AS m FROM {rows} GROUP BY {keys}, user_id) GROUP BY {keys}"""


def verdict(fixed: float | None = None) -> str:
    """CASE over columns m1, t1, df1 (train) and m2, t2, df2 (test)."""
    return f"""CASE WHEN NOT {significant('t1', 'df1', fixed)} THEN 'INSUFFICIENT_INSAMPLE_EDGE'
      WHEN m2 IS NULL OR isinf(m2) OR isnan(m2) OR t2 IS NULL OR isnan(t2) THEN 'INSUFFICIENT_DATA'
      WHEN sign(m1) * sign(m2) < 0 THEN 'OVERFITTED'
      WHEN NOT {significant('t2', 'df2', fixed)} THEN CASE WHEN m2 / m1 < 0.3::DOUBLE THEN 'OVERFITTED' ELSE 'WEAK' END
      WHEN m1 = 0 THEN 'WEAK' WHEN m2 / m1 >= 0.7::DOUBLE THEN 'ROBUST' WHEN m2 / m1 >= 0.4::DOUBLE THEN 'MODERATE' ELSE 'WEAK' END"""


RETENTION = "CASE WHEN verdict NOT LIKE 'INSUFFICIENT%' THEN round(m2 / m1, 6) END"


def walk_forward(offset: float, purge: int = 0, embargo: int = 0, frac: float = 0.7, min_n: int = 8, fixed: float | None = None, cluster: bool = False) -> str:
    stats = cluster_stats("role") if cluster else plain_stats("role")
    return f"""
    WITH {split_days(EVENTS.format(offset=offset), frac)}, {roles(purge, embargo)}, st AS ({stats}),
    w AS (SELECT max(CASE WHEN role = 'train' THEN n END) AS n1, max(CASE WHEN role = 'test' THEN n END) AS n2,
          max(CASE WHEN role = 'train' THEN m END) AS m1, max(CASE WHEN role = 'test' THEN m END) AS m2,
          max(CASE WHEN role = 'train' THEN t END) AS t1, max(CASE WHEN role = 'test' THEN t END) AS t2,
          max(CASE WHEN role = 'train' THEN df END) AS df1, max(CASE WHEN role = 'test' THEN df END) AS df2,
          coalesce(max(CASE WHEN role = 'purged' THEN n END), 0) AS np, coalesce(max(CASE WHEN role = 'embargoed' THEN n END), 0) AS ne FROM st),
    v AS (SELECT *, coalesce(n1, 0) < {min_n} OR coalesce(n2, 0) < {min_n} AS short, CASE WHEN coalesce(n1, 0) < {min_n} OR coalesce(n2, 0) < {min_n} THEN 'INSUFFICIENT_DATA' ELSE {verdict(fixed)} END AS verdict FROM w)
    SELECT verdict, CAST(coalesce(n1, 0) AS BIGINT) AS n_train, CAST(coalesce(n2, 0) AS BIGINT) AS n_test, CASE WHEN NOT short THEN round(m1, 6) END AS train_mean, CASE WHEN NOT short THEN round(m2, 6) END AS test_mean,
           CASE WHEN NOT short THEN round(t1, 6) END AS train_t, CASE WHEN NOT short THEN round(t2, 6) END AS test_t, {RETENTION} AS retention_ratio,
           NOT short AND verdict = 'OVERFITTED' AND sign(m1) * sign(m2) < 0 AS sign_flipped, CAST(np AS BIGINT) AS n_purged_train, CAST(ne AS BIGINT) AS n_embargoed_test FROM v"""


def groups(source: str, n: int) -> str:
    """CTEs: src, h, gr (d, n, gid)."""
    return f"""
    src AS ({source}),
    h AS (SELECT d, count(*) AS n, sum(count(*)) OVER (ORDER BY d) - count(*) AS s, sum(count(*)) OVER (ORDER BY d) AS e, sum(count(*)) OVER () AS total FROM src GROUP BY d),
    ideal AS (SELECT greatest(1, least(total - 1, round_even(total * i / least({n}, total)::DOUBLE, 0))) AS c FROM (SELECT DISTINCT total FROM h), (SELECT unnest(generate_series(1, {n - 1})) AS i) WHERE i < least({n}, total)),
    cuts AS (SELECT DISTINCT CASE WHEN c - s <= e - c THEN s ELSE e END AS c FROM ideal, h WHERE s <= c AND c < e),
    gr AS (SELECT d, n, (SELECT count(*) FROM cuts WHERE c > 0 AND c < total AND c <= s) AS gid FROM h)"""


def paths(purge: int, embargo: int) -> str:
    """CTEs: pt (path, a, b), rl (path, d, n, role): two held-out groups."""
    return f"""
    sp AS (SELECT gid, min(d) AS first, max(d) AS last FROM gr GROUP BY gid),
    pt AS (SELECT x.gid AS a, y.gid AS b, x.gid || ',' || y.gid AS path, x.first AS f1, CASE WHEN y.gid = x.gid + 1 THEN y.last ELSE x.last END AS l1,
                  CASE WHEN y.gid > x.gid + 1 THEN y.first END AS f2, CASE WHEN y.gid > x.gid + 1 THEN y.last END AS l2 FROM sp x JOIN sp y ON x.gid < y.gid),
    rl AS (SELECT path, d, n, CASE
        WHEN gid IN (a, b) THEN CASE WHEN (d BETWEEN f1 AND l1 AND d < f1 + INTERVAL {embargo} DAY) OR (d BETWEEN f2 AND l2 AND d < f2 + INTERVAL {embargo} DAY) THEN 'embargoed' ELSE 'test' END
        WHEN (d < f1 AND d >= f1 - INTERVAL {purge} DAY) OR (d > l1 AND d <= l1 + INTERVAL {purge} DAY) THEN 'purged'
        WHEN d > l1 + INTERVAL {purge} DAY AND d <= l1 + INTERVAL {purge + embargo} DAY THEN 'embargoed'
        WHEN (d < f2 AND d >= f2 - INTERVAL {purge} DAY) OR (d > l2 AND d <= l2 + INTERVAL {purge} DAY) THEN 'purged'
        WHEN d > l2 + INTERVAL {purge} DAY AND d <= l2 + INTERVAL {purge + embargo} DAY THEN 'embargoed' ELSE 'train' END AS role FROM gr, pt)"""


def cpcv(offset: float, cluster: bool = False) -> str:
    """CTE pv: one row per path with verdict and retention."""
    stats = cluster_stats("path, role", "rr") if cluster else plain_stats("path, role", "rr")
    pick = lambda f, r: f"max(CASE WHEN role = '{r}' THEN {f} END)"
    return f"""
    WITH {groups(EVENTS.format(offset=offset), 6)}, {paths(2, 1)},
    rr AS (SELECT path, role, x, user_id FROM src JOIN rl USING (d) WHERE role IN ('train', 'test')), st AS ({stats}),
    w AS (SELECT path, {pick('n', 'train')} AS n1, {pick('n', 'test')} AS n2, {pick('m', 'train')} AS m1, {pick('m', 'test')} AS m2, {pick('t', 'train')} AS t1, {pick('t', 'test')} AS t2,
          {pick('df', 'train')} AS df1, {pick('df', 'test')} AS df2 FROM st GROUP BY path),
    pv AS (SELECT *, {verdict()} AS verdict FROM w)"""


def panel() -> str:
    return """
    p AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS cohort, CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount AS DOUBLE) AS z, l_returnflag = 'R' AS g
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def series_test(slopes: str, lags: int = 0) -> str:
    hac = " + ".join(["sum(u * u)", *(f"{2 * (1 - k / (lags + 1))!r}::DOUBLE * sum(u * l{k})" for k in range(1, lags + 1))])
    lagged = "".join(f", lag(estimate, {k}) OVER (ORDER BY cohort) - avg(estimate) OVER () AS l{k}" for k in range(1, lags + 1))
    se = f"sqrt(({hac}) / count(*) / count(*))" if lags else "stddev_samp(estimate) / sqrt(count(*))"
    return f"""
    s AS ({slopes}), u AS (SELECT *, estimate - avg(estimate) OVER () AS u{lagged} FROM s WHERE estimate IS NOT NULL),
    a AS (SELECT avg(estimate) AS m, stddev_samp(estimate) AS sd, avg(estimate) / ({se}) AS t, CAST(count(*) - 1 AS DOUBLE) AS df, count(*) AS n FROM u)
    SELECT round(m, 6) AS mean_estimate, round(sd, 6) AS std_estimate, round(t, 6) AS t_stat, round({p_value('t', 'df')}, 9) AS p_value, n AS n_periods, coalesce({p_value('t', 'df')} < 0.05::DOUBLE, false) AS significant FROM a"""


SLOPES = "SELECT cohort, regr_slope(y, x) AS estimate FROM p GROUP BY cohort"
DIFFS = "SELECT cohort, avg(y) FILTER (g) - avg(y) FILTER (NOT g) AS estimate FROM p GROUP BY cohort"
WINSORIZED = """SELECT cohort, regr_slope(y, greatest(lo, least(hi, x))) AS estimate FROM p JOIN
    (SELECT cohort, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM p GROUP BY cohort) USING (cohort) GROUP BY cohort"""
MULTI = """SELECT cohort, k.x_col, CASE WHEN k.x_col = 'x' THEN (xy * zz - zy * xz) / (xx * zz - xz * xz) ELSE (zy * xx - xy * xz) / (xx * zz - xz * xz) END AS estimate
    FROM (SELECT cohort, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, covar_pop(x, z) AS xz, var_pop(x) AS xx, var_pop(z) AS zz FROM p GROUP BY cohort), (VALUES ('x'), ('z')) k(x_col)"""


def tests() -> str:
    """CTE q: family (event type), ordinal (user), p of a t test of the user's values against 50."""
    return f"""
    st AS (SELECT event_type AS family, user_id AS ordinal, avg(value - 50) / (stddev_samp(value) / sqrt(count(*))) AS t, CAST(count(*) - 1 AS DOUBLE) AS df FROM events GROUP BY ALL HAVING count(*) >= 3),
    q AS (SELECT family, ordinal, round({p_value('t', 'df')}, 9) AS p, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY round({p_value('t', 'df')}, 9), ordinal) AS k FROM st)"""


def corrected(method: str) -> str:
    keep = {
        "bonferroni": "p <= 0.2::DOUBLE / m",
        "holm": "k < coalesce((SELECT min(k) FROM q f WHERE f.family = q.family AND f.p > 0.2::DOUBLE / (f.m - f.k + 1)), 1e18)",
        "fdr_bh": "k <= coalesce((SELECT max(k) FROM q f WHERE f.family = q.family AND f.p <= f.k / f.m::DOUBLE * 0.2::DOUBLE), 0)",
    }[method]
    return f"WITH {tests()} SELECT family, CAST(ordinal AS VARCHAR) AS label, p AS p_value, p <= 0.2::DOUBLE AS significant_uncorrected, {keep} AS significant_corrected, '{method}' AS method, m AS n_tests FROM q"
