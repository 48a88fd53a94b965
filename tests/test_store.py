import glob
import os

import pytest

from veritrail.sources.store import KeyedStore, append_dedup
from veritrail.streaming.keyed import stream_into_store


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_round_trip_keeps_last_and_sorts_as_text(spark, tmp_path):
    at = str(tmp_path / "deep" / "store.csv")
    append_dedup(rows(spark, [(9, "pending"), (10, "pending")], "id int, status string"), at, ["id"])
    got = append_dedup(rows(spark, [(9, "confirmed"), (9, "final")], "id int, status string"), at, ["id"])
    assert [(r.id, r.status) for r in got.collect()] == [("10", "pending"), ("9", "final")]
    again = append_dedup(rows(spark, [(9, "final")], "id int, status string"), at, ["id"])
    assert again.count() == 2


def test_keys_compare_as_text(spark, tmp_path):
    at = str(tmp_path / "s")
    append_dedup(rows(spark, [("007", 1), (None, 2)], "id string, v int"), at, ["id"])
    append_dedup(rows(spark, [(1.0, 3), (None, 4)], "id double, v int"), at, ["id"])
    got = {r.id: r.v for r in append_dedup(rows(spark, [("1", 5)], "id string, v int"), at, ["id"]).collect()}
    assert got == {"007": 1, "1": 5, None: 4}


def test_missing_key_leaves_store(spark, tmp_path):
    at = str(tmp_path / "s")
    append_dedup(rows(spark, [(1, 1)], "id int, v int"), at, ["id"])
    before = sorted(os.listdir(at))
    with pytest.raises(ValueError):
        append_dedup(rows(spark, [(1, 1)], "id int, v int"), at, ["other"])
    assert sorted(os.listdir(at)) == before


def test_corrupt_store_is_moved_aside(spark, tmp_path):
    at = tmp_path / "s.csv"
    at.write_text("id,v\n1,2\n3,4,5,6\n")
    empty = rows(spark, [], "id int, v int")
    assert append_dedup(empty, str(at), ["id"]).count() == 0 and at.exists()
    got = append_dedup(rows(spark, [(8, 9)], "id int, v int"), str(at), ["id"])
    assert got.count() == 1 and len(glob.glob(f"{at}.corrupt-*")) == 1


def test_empty_file_and_short_rows(spark, tmp_path):
    at = tmp_path / "s.csv"
    at.write_text("")
    assert append_dedup(rows(spark, [(8, 9)], "id int, v int"), str(at), ["id"]).count() == 1
    assert not glob.glob(f"{at}.corrupt-*")
    other = tmp_path / "t.csv"
    other.write_text("id,v\n1,2\n3\n")
    assert append_dedup(rows(spark, [(8, 9)], "id int, v int"), str(other), ["id"]).count() == 3


def test_failed_write_keeps_old(spark, tmp_path):
    at = str(tmp_path / "s")
    append_dedup(rows(spark, [(1, 1)], "id int, v int"), at, ["id"])
    store = KeyedStore(spark, at, ["id"])
    with pytest.raises(Exception):
        store.write(spark.range(1).selectExpr("array(id) as a"))
    assert store.read().count() == 1 and not glob.glob(f"{at}.tmp*")


def test_marks_of_missing_values_are_exact(spark, tmp_path):
    at = str(tmp_path / "s")
    data = [("none", 1), ("None", 2), (" NA", 3), ("NA", 4), ("-nan", 5), ("#NA", 6), ("x ", 7)]
    append_dedup(rows(spark, data, "id string, v int"), at, ["id"])
    again = append_dedup(rows(spark, [("none", 10)], "id string, v int"), at, ["id"])
    assert {r.id for r in again.collect()} == {"none", " NA", "x ", None} and {r.id: r.v for r in again.collect()}["none"] == 10


@pytest.mark.parametrize("dies_at", [0, 1, 2])
def test_a_write_that_dies_leaves_old_or_new_rows(spark, tmp_path, monkeypatch, dies_at):
    at = str(tmp_path / "s")
    append_dedup(rows(spark, [(1, "a"), (2, "b")], "id int, v string"), at, ["id"])

    class Died(BaseException):
        pass

    steps = []

    def dying(self, source, target, plain=KeyedStore._rename):
        if len(steps) == dies_at:
            raise Died
        steps.append(target)
        plain(self, source, target)
        if dies_at == 2 and len(steps) == 2:
            raise Died

    with monkeypatch.context() as m:
        m.setattr(KeyedStore, "_rename", dying)
        with pytest.raises(Died):
            append_dedup(rows(spark, [(3, "c")], "id int, v string"), at, ["id"])
    there = {r.id for r in KeyedStore(spark, at, ["id"]).read().collect()}
    assert there == ({"1", "2", "3"} if dies_at == 2 else {"1", "2"})
    done = append_dedup(rows(spark, [(4, "d")], "id int, v string"), at, ["id"])
    assert {r.id for r in done.collect()} == there | {"4"}
    assert {r.id for r in KeyedStore(spark, at, ["id"]).read().collect()} == there | {"4"}


def test_stream_into_store(spark, tmp_path):
    src = str(tmp_path / "in")
    rows(spark, [(1, "a"), (2, "b")], "id int, v string").write.parquet(src)
    rows(spark, [(3, "c")], "id int, v string").write.mode("append").parquet(src)
    stream = spark.readStream.schema("id int, v string").parquet(src)
    q = stream_into_store(stream, str(tmp_path / "s"), ["id"], str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert KeyedStore(spark, str(tmp_path / "s"), ["id"]).read().count() == 3
