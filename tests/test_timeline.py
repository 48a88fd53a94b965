import datetime as dt

import pytest

from veritrail.operators import timeline


def days(spark, offsets):
    base = dt.date(2024, 1, 1)
    return spark.createDataFrame([(base + dt.timedelta(days=o), float(i)) for i, o in enumerate(offsets)], "d date, v double")


def test_split_sorts_before_it_cuts(spark):
    train, test = timeline.chronological_split(days(spark, [3, 0, 2, 1]), "d", 0.5)
    assert sorted(r.v for r in train.collect()) == [1.0, 3.0] and sorted(r.v for r in test.collect()) == [0.0, 2.0]


def test_tied_date_goes_to_one_side(spark):
    train, test = timeline.chronological_split(days(spark, [*range(10), *[10] * 20, *range(11, 21)]), "d", 0.7)
    assert (train.count(), test.count()) == (30, 10)
    assert not {r.d for r in train.collect()} & {r.d for r in test.collect()}


@pytest.mark.parametrize("n, want", [(10, (7, 3)), (20, (14, 6)), (1, (0, 1))])
def test_plain_cuts(spark, n, want):
    train, test = timeline.chronological_split(days(spark, range(n)), "d", 0.7)
    assert (train.count(), test.count()) == want


def test_purge_and_embargo_counts(spark):
    df = days(spark, range(30))
    train, test = df.where("d < '2024-01-21'"), df.where("d >= '2024-01-21'")
    a, b, purged, held = timeline.apply_purge_embargo(train, test, "d", 5, 3)
    assert (a.count(), b.count(), purged, held) == (15, 7, 5, 3)


def test_purge_is_strict_at_its_edge(spark):
    df = days(spark, range(20))
    a, _, purged, _ = timeline.apply_purge_embargo(df.where("d < '2024-01-11'"), df.where("d >= '2024-01-11'"), "d", 3)
    assert purged == 3 and max(r.d for r in a.collect()) == dt.date(2024, 1, 7)


def test_text_dates(spark):
    iso = spark.createDataFrame([("2024-01-02", 1.0), ("20240101", 2.0)], "d string, v double")
    train, _ = timeline.chronological_split(iso, "d", 0.5)
    assert [r.d for r in train.collect()] == ["20240101"]
    with pytest.raises(TypeError, match="ISO-8601"):
        timeline.date_sort_key(spark.createDataFrame([("31/12/2024",)], "d string"), "d")
    with pytest.raises(ValueError, match="missing"):
        timeline.date_sort_key(spark.createDataFrame([("2024-01-01",), (None,)], "d string"), "d")


def test_numeric_dates_and_bad_fraction(spark):
    df = spark.createDataFrame([(2010 + i,) for i in range(10)], "y int")
    train, test = timeline.chronological_split(df, "y", 0.5)
    assert max(r.y for r in train.collect()) < min(r.y for r in test.collect())
    with pytest.raises(ValueError):
        timeline.chronological_split(df, "y", 1.0)
