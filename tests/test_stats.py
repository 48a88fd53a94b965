import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.functions.student import critical_value, two_sided_p_exact
from veritrail.operators import stats
from veritrail.operators.stats import StatResult
from veritrail.operators.verdict import classify_overfitting


def frame(spark, values, **more):
    names = list(more)
    rows = [(None if v is None else float(v), i, *(more[k][i] for k in names)) for i, v in enumerate(values)]
    kinds = ", ".join(f"{k} {'boolean' if isinstance(more[k][0], (bool, np.bool_)) else 'int'}" for k in names)
    rows = [tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in rows]
    return spark.createDataFrame(rows, "v double, i int" + (", " + kinds if kinds else ""))


def sandwich(y, x, clusters=None, lags=None):
    """Reference in numpy: explicit matrices."""
    X = np.ones((len(y), 1)) if x is None else np.c_[np.ones(len(y)), x]
    inv = np.linalg.inv(X.T @ X)
    b = inv @ X.T @ y
    u = y - X @ b
    n, k = X.shape
    if clusters is not None:
        s = np.array([X[clusters == c].T @ u[clusters == c] for c in np.unique(clusters)])
        g = len(s)
        V = inv @ (s.T @ s) @ inv * g / (g - 1) * (n - 1) / (n - k)
    elif lags is not None:
        m = X * u[:, None]
        S = m.T @ m
        for l in range(1, lags + 1):
            w = 1 - l / (lags + 1)
            S = S + w * (m[l:].T @ m[:-l] + m[:-l].T @ m[l:])
        V = inv @ S @ inv
    else:
        V = inv * (u @ u) / (n - k)
    return b[-1], b[-1] / math.sqrt(V[-1, -1])


def test_plain_matches_hand_formula(spark):
    v = [1, 2, 3, -1, 2.5, 1.5, 0.5, 3]
    got = stats.stat_vs_zero(frame(spark, v), "v")
    want = np.mean(v) / (np.std(v, ddof=1) / math.sqrt(len(v)))
    assert got.n == 8 and got.df == 7 and math.isclose(got.t_stat, want, rel_tol=1e-12)


@pytest.mark.parametrize("seed", range(4))
def test_all_errors_match_matrices(spark, seed):
    rng = np.random.default_rng(seed)
    y, g, c = rng.normal(0.4, 1, 90), rng.random(90) < 0.4, rng.integers(0, 9, 90)
    df = frame(spark, y, g=g, c=c).repartition(3)
    for x, run in ((None, lambda **k: stats.stat_vs_zero(df, "v", **k)), (g.astype(float), lambda **k: stats.stat_group_diff(df, "v", "g", **k))):
        for ours, theirs in (({}, {}), ({"cluster_groups": "c"}, {"clusters": c}), ({"maxlags": 3, "order": ["i"]}, {"lags": 3})):
            b, t = sandwich(y, x, **theirs)
            got = run(**ours)
            assert math.isclose(got.mean, b, rel_tol=1e-9) and math.isclose(got.t_stat, t, rel_tol=1e-9)


def test_nonfinite_values_are_scrubbed(spark):
    df = frame(spark, [1.0, float("nan"), 2.0, float("inf"), None, 3.0, float("-inf")])
    assert stats.stat_vs_zero(df, "v").n == 3


def test_small_and_degenerate(spark):
    one = stats.stat_vs_zero(frame(spark, [2.0]), "v")
    assert (one.mean, one.t_stat, one.n, one.significant) == (2.0, None, 1, False)
    const = stats.stat_vs_zero(frame(spark, [0.1] * 9), "v")
    assert const.t_stat == math.inf and const.significant
    lonely = stats.stat_group_diff(frame(spark, [1.0, 2.0, 3.0], g=[True, False, False]), "v", "g")
    assert lonely.mean is None and lonely.n == 3 and not lonely.significant
    assert stats.stat_vs_zero(frame(spark, [1.0]).limit(0), "v").n == 0


def test_one_cluster_falls_back_to_plain(spark):
    v = [1.0, 2.0, 4.0, 3.0]
    got = stats.stat_vs_zero(frame(spark, v, c=[1, 1, 1, 1]), "v", cluster_groups="c")
    assert got.n_clusters == 1 and math.isclose(got.t_stat, stats.stat_vs_zero(frame(spark, v), "v").t_stat)
    with pytest.raises(ValueError, match="missing"):
        stats.stat_vs_zero(frame(spark, v).withColumn("c", F.lit(None).cast("int")), "v", cluster_groups="c")


def test_critical_values():
    assert round(critical_value(7), 3) == 2.365 and round(critical_value(1), 3) == 12.706
    assert abs(two_sided_p_exact(critical_value(50), 50) - 0.05) < 1e-12
    assert abs(critical_value(10_000) - 1.9602) < 1e-3 and critical_value(0) == math.inf


def s(mean, t, n=100, clusters=None):
    return StatResult(mean, t, n, False, clusters)


@pytest.mark.parametrize(
    "train, test, verdict, flipped",
    [
        (s(1, 1), s(1, 5), "INSUFFICIENT_INSAMPLE_EDGE", False),
        (s(1, 5), s(float("nan"), float("nan")), "INSUFFICIENT_DATA", False),
        (s(1, 5), s(-1, -5), "OVERFITTED", True),
        (s(1, 5), s(0.2, 1), "OVERFITTED", False),
        (s(1, 5), s(0.5, 1), "WEAK", False),
        (s(1, 5), s(0.7, 3), "ROBUST", False),
        (s(1, 5), s(0.4, 3), "MODERATE", False),
        (s(1, 5), s(0.3, 3), "WEAK", False),
        (s(1, math.inf), s(-1, -math.inf), "OVERFITTED", True),
    ],
)
def test_verdict_rules(spark, train, test, verdict, flipped):
    got = classify_overfitting(train, test)
    assert got[0] == verdict and got[3] is flipped


def test_critical_value_is_printed(spark):
    assert "2.36" in classify_overfitting(s(1, 1.0, 8), s(1, 5))[1]


@pytest.mark.parametrize("constant", [False, True])
def test_merged_cells_equal_direct_evaluation(spark, constant):
    rng = np.random.default_rng(9)
    n = 200
    y = np.full(n, 0.1) if constant else rng.normal(0.2, 1, n)
    df = frame(spark, y, g=rng.random(n) < 0.5, c=rng.integers(0, 6, n), day=rng.integers(0, 15, n)).withColumn("half", F.col("day") % 2)
    for spec in (stats.vs_zero("v"), stats.vs_zero("v", cluster="c"), stats.group_diff("v", "g"), stats.group_diff("v", "g", cluster="c")):
        want = {r.half: r for r in stats.evaluate(df, spec, ["half"]).collect()}
        parts = stats.cells(df, spec, ["day"]).withColumn("half", F.col("day") % 2)
        for r in stats.evaluate_cells(parts, spec, ["half"]).collect():
            w = want[r.half]
            assert (r.n, r.n_rows, r.n_clusters, r.df, r.significant) == (w.n, w.n_rows, w.n_clusters, w.df, w.significant)
            assert math.isclose(r.mean, w.mean, rel_tol=1e-9, abs_tol=1e-12) and (r.t_stat == w.t_stat or constant or math.isclose(r.t_stat, w.t_stat, rel_tol=1e-9))


def test_labels_are_matched_once(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (None, 3.0)], "k int, v double")
    labels = spark.createDataFrame([(2, "b"), (None, "n"), (1, "a"), (9, "z")], "k int, c string")
    got = stats.with_labels(df, labels, ["k"], "c")
    assert got.columns == ["k", "v", "c"] and {(r.k, r.c) for r in got.collect()} == {(1, "a"), (2, "b"), (None, "n")}
    with pytest.raises(ValueError):
        stats.with_labels(df, labels.where("k = 1"), ["k"], "c")
    with pytest.raises(ValueError):
        stats.with_labels(df, labels.union(labels), ["k"], "c")
