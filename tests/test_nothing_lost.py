"""Rows and state that earlier versions could lose: null groups, null times, crashes between store steps."""
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scholarsieve.operators import fulltext, ledger, merge, ranking
from scholarsieve.sources.sinks import POINTER, Conflict, Store
from scholarsieve.streaming import rolling


def frame(spark):
    rows = [(None if i % 2 else "g", i, 1.0 if i % 3 else None) for i in range(20)]
    return spark.createDataFrame(rows, "g string, id int, cost double").repartition(5).withColumn("order", ranking.key("id"))


def test_a_null_group_has_quotas_positions_and_slots(spark):
    rows = frame(spark)
    within = ranking.mark_quota(rows, ["g"], "order", 2).where("within").collect()
    assert sorted(r.id for r in within) == [0, 1, 2, 3]
    positions = {r.id: r.position for r in ranking.positions(rows, ["g"], "order").collect()}
    assert positions == {i: i // 2 + 1 for i in range(20)}
    picks = ranking.fill_slots(rows.where("id >= 4"), rows.where("id < 4"), ["g"], "order", 5).collect()
    assert sorted(r.id for r in picks) == [4, 5, 6, 7, 8, 9]
    guarded = ledger.guard_calls(rows, ["g"], "order", 2.0)
    assert guarded.count() == 20 and guarded.where("g is null and guard = 'allowed'").count() > 0


def test_null_headings_are_numbered(spark):
    lines = spark.createDataFrame([("d", None, 1), ("d", None, 2), ("d", "A", 3)], "doc string, name string, pos int")
    got = [r.locator for r in fulltext.number_occurrences(lines, ["doc"], "name", "pos").orderBy("pos").collect()]
    assert got == ["section:", "section:#2", "section:A"]


def test_rows_without_a_time_are_late_and_without_an_arrival_last(spark):
    rows = spark.createDataFrame([("a", None), ("b", datetime(2020, 1, 1)), ("c", datetime(2026, 1, 1))], "base_id string, published timestamp_ntz")
    on_time, late = rolling.split_late(rows, F.lit(datetime(2026, 1, 2)).cast("timestamp_ntz"), 14)
    assert [r.base_id for r in on_time.collect()] == ["c"] and sorted(r.base_id for r in late.collect()) == ["a", "b"]
    found = spark.createDataFrame([("a", 1), ("b", None), ("c", 2)], "base_id string, arrival long")
    known = found.limit(0)
    assert sorted(r.base_id for r in merge.admit(found, known, 3).collect()) == ["a", "b", "c"]
    assert sorted(r.base_id for r in merge.admit(found, known, 2).collect()) == ["a", "c"]


def test_a_crash_between_the_steps_keeps_the_last_state(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.load("papers") is None
    store.save("papers", spark.range(3))
    store.save("papers", spark.range(5))
    # Data of a third version without a pointer, then a pointer that was cut off.
    spark.range(9).write.parquet(str(tmp_path / "s/papers/half"))
    assert store.load("papers").count() == 5
    (tmp_path / "s/papers" / f"{POINTER}{3:012d}").write_text("")
    assert store.load("papers").count() == 5
    store.save("papers", spark.range(7))
    assert store.load("papers").count() == 7


def test_versions_without_a_pointer_are_an_error_not_an_empty_state(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    spark.range(3).write.parquet(str(tmp_path / "s/papers/v1"))
    with pytest.raises(Conflict):
        store.load("papers")


def test_two_writers_of_one_number_conflict(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.save("papers", spark.range(1))
    number, _ = store._pointer("papers")
    with pytest.raises(Exception):
        store._write_text(f"{store.root}/papers/{POINTER}{number:012d}", "other\n", overwrite=False)


def test_logs_are_read_without_success_markers(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.log("events", "id long").count() == 0
    store.append("events", spark.range(4))
    for marker in (tmp_path / "s/events.log").glob("*_SUCCESS*"):
        marker.rename(tmp_path / marker.name)
    assert store.log("events", "id long").count() == 4
