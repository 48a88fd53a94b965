import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail import api


def daily(spark, values, step=1, **more):
    base = dt.date(2024, 1, 1)
    names = list(more)
    rows = [(base + dt.timedelta(days=step * i), float(v), *(more[k][i] for k in names)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date date, r double" + "".join(f", {k} {'boolean' if isinstance(more[k][0], bool) else 'int'}" for k in names))


def test_walk_forward_constant_reversal(spark):
    got = api.walk_forward_validate(daily(spark, [5.0] * 70 + [-5.0] * 30), "date", api.vs_zero("r"))
    assert got.verdict == "OVERFITTED" and got.sign_flipped


def test_walk_forward_real_edge_and_callable(spark):
    df = daily(spark, np.random.default_rng(1).normal(2, 1, 100))
    got = api.walk_forward_validate(df, "date", api.vs_zero("r"))
    assert got.verdict in ("ROBUST", "MODERATE") and got.train.n == 70

    def own(frame):
        x = frame["r"]
        return api.StatResult(x.mean(), x.mean() / (x.std() / len(x) ** 0.5), len(x), True)

    other = api.walk_forward_validate(df, "date", own)
    assert other.verdict == got.verdict and abs(other.train.t_stat - got.train.t_stat) < 1e-9


def test_walk_forward_counts_and_notes(spark):
    df = daily(spark, [2.0 + 0.1 * (i % 3) for i in range(100)], c=[i % 5 for i in range(100)])
    got = api.walk_forward_validate(df, "date", api.vs_zero("r", cluster="c"), purge_days=3, embargo_days=2)
    assert (got.n_purged_train, got.n_embargoed_test) == (3, 2)
    assert "purged" in got.reasoning and "CAVEAT" in got.reasoning and "fewer than" in got.reasoning
    short = api.walk_forward_validate(daily(spark, [2.0] * 20), "date", api.vs_zero("r"), purge_days=100)
    assert short.verdict == "INSUFFICIENT_DATA" and short.train.n == 0


def test_order_of_rows_does_not_matter(spark):
    x = np.convolve(np.random.default_rng(3).normal(0.5, 1, 260), np.ones(20) / 20, "valid")
    df = daily(spark, x)
    spec = api.vs_zero("r", maxlags=5, order=["date"])
    a, b = api.walk_forward_validate(df, "date", spec), api.walk_forward_validate(df.orderBy(F.rand(1)).repartition(5), "date", spec)
    assert abs(a.train.t_stat - b.train.t_stat) < 1e-9


@pytest.mark.parametrize("groups, purge, embargo, want", [([1], 5, 0, (90, 20, 10, 0)), ([1, 4], 3, 0, (68, 40, 12, 0)), ([1], 5, 3, (87, 17, 10, 6))])
def test_purged_frames(spark, groups, purge, embargo, want):
    train, test, purged, held = api.build_split_frames(daily(spark, range(120)), "date", 6, groups, purge, embargo)
    assert (train.count(), test.count(), purged, held) == want


def test_groups_respect_ties(spark):
    base = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(base + dt.timedelta(days=min(i, 9)), 1.0) for i in range(30)], "d date, r double")
    assert api.assign_groups(df, "d", 3).where("d = '2024-01-10'").select("gid").distinct().count() == 1


def test_cpcv_end_to_end(spark):
    rng = np.random.default_rng(5)
    good = api.cpcv_validate(daily(spark, rng.normal(2, 3, 240), 7), "date", api.vs_zero("r"))
    assert len(good.paths) == 15 and good.overall_verdict == "ROBUST"
    assert "15 path(s)" in api.format_cpcv_print_line(good) and api.format_cpcv_registry_note(good).startswith(" CPCV (6 groups, C(6,2)=15")
    starved = api.cpcv_validate(daily(spark, [1.0] * 30, 7), "date", api.vs_zero("r"), min_n_per_split=100)
    assert starved.n_splits_skipped == 15 and starved.overall_verdict == "INSUFFICIENT_DATA" and not starved.paths
    assert api.cpcv_validate(daily(spark, [1.0]), "date", api.vs_zero("r"), n_groups=1).overall_verdict == "INSUFFICIENT_DATA"
    assert "n/a" in api.format_cpcv_print_line(starved)


def test_cpcv_overall_thresholds(spark):
    assert api.classify_cpcv_overall(["ROBUST"] * 7 + ["WEAK"] * 3)[0] == "ROBUST"
    assert api.classify_cpcv_overall(["ROBUST"] * 4 + ["WEAK"] * 6)[0] == "MODERATE"
    assert api.classify_cpcv_overall(["OVERFITTED"] * 6 + ["WEAK"] * 4)[0] == "OVERFITTED"
    assert api.classify_cpcv_overall(["WEAK", "INSUFFICIENT_DATA"])[0] == "WEAK"
    assert api.classify_cpcv_overall([])[2] is None


def test_splits_partition():
    for train, test in api.generate_cpcv_splits(6, 2):
        assert not train & test and train | test == frozenset(range(6))


def panel(spark, slope, cohorts=12, n=40, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(cohorts):
        x, z, e = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
        rows += [(c, float(a), float(b), float(slope * a - 0.3 * b + k), bool(a > 0)) for a, b, k in zip(x, z, e, strict=True)]
    return spark.createDataFrame(rows, "cohort int, x double, z double, y double, g boolean")


def test_cohort_slopes(spark):
    df = panel(spark, 0.5)
    extra = spark.createDataFrame([(99, 1.0, 1.0, 1.0, True)] * 2 + [(100, 2.0, 1.0, float(i), True) for i in range(20)] + [(None, 1.0, 1.0, 1.0, True), (1, float("inf"), 1.0, 1.0, False)], df.schema)
    got = api.fama_macbeth_regression(df.union(extra), "cohort", "x", "y")
    assert got.dropped_cohorts == [99, 100] and got.n_periods == 12 and got.significant and abs(got.mean_estimate - 0.5) < 0.1
    p = df.where("cohort = 3").toPandas()
    assert abs(got.period_estimates[3] - np.polyfit(p.x, p.y, 1)[0]) < 1e-9
    lagged = api.fama_macbeth_regression(df, "cohort", "x", "y", newey_west_lags=3)
    assert abs(lagged.mean_estimate - api.fama_macbeth_regression(df, "cohort", "x", "y").mean_estimate) < 1e-12


def test_cohort_multi_and_diff(spark):
    df = panel(spark, 0.5)
    bad = spark.createDataFrame([(100, float(i), 2.0 * i, float(i % 3), True) for i in range(20)] + [(99, 1.0, 2.0, 3.0, True)] * 5, df.schema)
    got = api.fama_macbeth_multi_regression(df.union(bad), "cohort", ["x", "z"], "y")
    assert got.dropped_cohorts == [99, 100] and abs(got.mean_estimate["z"] + 0.3) < 0.1 and got.significant["x"]
    p = df.where("cohort = 0").toPandas()
    want = np.linalg.lstsq(np.c_[np.ones(len(p)), p.x, p.z], p.y, rcond=None)[0]
    assert abs(got.period_estimates[0]["x"] - want[1]) < 1e-9
    diff = api.fama_macbeth_group_diff(df, "cohort", "g", "y")
    assert abs(diff.period_estimates[0] - (p.y[p.g].mean() - p.y[~p.g].mean())) < 1e-9
    few = api.fama_macbeth_regression(df.where("cohort < 2"), "cohort", "x", "y")
    assert few.mean_estimate is not None and few.t_stat is None and not few.significant
    with pytest.raises(ValueError):
        api.fama_macbeth_regression(df, "cohort", "x", "y", significance_alpha=0)


def _holm(p, a):
    out, order = [False] * len(p), sorted(range(len(p)), key=lambda i: p[i])
    for k, i in enumerate(order):
        if p[i] > a / (len(p) - k):
            break
        out[i] = True
    return out


def _bh(p, a):
    order = sorted(range(len(p)), key=lambda i: p[i])
    top = max([k + 1 for k, i in enumerate(order) if p[i] <= (k + 1) / len(p) * a], default=0)
    out = [False] * len(p)
    for i in order[:top]:
        out[i] = True
    return out


def test_corrections(spark):
    rng = np.random.default_rng(2)
    for n in (1, 7, 23):
        p = np.round(rng.random(n) ** 3, 3).tolist()
        assert api.bonferroni_correction(p) == [x <= 0.05 / n for x in p]
        assert api.holm_correction(p) == _holm(p, 0.05) and api.benjamini_hochberg_fdr(p) == _bh(p, 0.05)
    assert api.holm_correction([0.025, 0.05]) == [True, True] and api.bonferroni_correction([0.025, 0.025]) == [True, True]
    assert api.holm_correction([]) == [] and api.holm_correction([float("nan"), 0.001]) == [False, True]
    rows = api.summarize_correction(["a", "b"], [0.01, 0.04], method="fdr_bh")
    assert [r["significant_corrected"] for r in rows] == [True, True] and rows[0]["n_tests"] == 2
    for bad in (lambda: api.bonferroni_correction([0.1], 1.5), lambda: api.summarize_correction(["a"], [0.1], method="x"), lambda: api.summarize_correction(["a"], [])):
        with pytest.raises(ValueError):
            bad()
