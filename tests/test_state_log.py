"""State as a change log, the cursor stored with its batch, manual windows."""
import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from scholarsieve.functions import clock
from scholarsieve.plans.window import collection_window
from scholarsieve.sources.sinks import POINTER, Conflict, Store
from test_daily import NOW, fixture, start

KEYED = "k string, v int, extra string"


def rows(table):
    return sorted((r.k or "", r.v) for r in table.collect())


def versions(store, table):
    return store._pointer(table)[1]["versions"]


def test_changes_replace_rows_by_key_and_only_they_are_written(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    make = lambda pairs: spark.createDataFrame([(k, v, None) for k, v in pairs], KEYED)
    store.save("t", make([("a", 1), ("b", 1), (None, 1)]))
    store.change("t", make([("b", 2), ("c", 2)]), "k")
    table = store.change("t", make([("c", 3), (None, 3)]).drop("extra"), "k")
    assert rows(table) == [("", 3), ("a", 1), ("b", 2), ("c", 3)] and len(versions(store, "t")) == 3
    assert [spark.read.parquet(f"{store.root}/t/{v}").count() for v in versions(store, "t")] == [3, 2, 2]
    assert rows(store.compact("t")) == rows(table) and len(versions(store, "t")) == 1
    name = versions(store, "t")[0]
    store.compact("t")
    assert versions(store, "t") == [name]
    with pytest.raises(Conflict):
        store.change("t", make([("a", 9)]), "k")
        store.change("t", make([("a", 9)]), "v")


def test_notes_become_visible_with_their_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    make = lambda v: spark.createDataFrame([("a", v, None)], KEYED)
    assert store.notes("t") == {}
    store.change("t", make(1), "k", notes={"cursor": 1})
    store.change("t", make(2), "k", notes={"cursor": 2})
    newest = f"{store.root}/t/{POINTER}{2:012d}"
    store._write_text(newest, store._read_text(newest)[:-5])  # cut off while it was written
    store = Store(spark, str(tmp_path / "s"))
    assert rows(store.load("t")) == [("a", 1)] and store.notes("t") == {"cursor": 1}
    store.change("t", make(3), "k")
    assert store.notes("t") == {"cursor": 1} and rows(store.compact("t")) == [("a", 3)] and store.notes("t") == {"cursor": 1}


def test_tables_of_bare_pointers_are_read(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    spark.createDataFrame([("a", 1, None)], KEYED).write.parquet(str(tmp_path / "s/t/v1"))
    (tmp_path / "s/t" / f"{POINTER}{1:012d}").write_text("v1\n")
    assert rows(store.change("t", spark.createDataFrame([("b", 2, None)], KEYED), "k")) == [("a", 1), ("b", 2)]


def test_reports_are_replaced_in_one_step(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for n in (1, 2):
        store.report("reports/x.json", {"n": n})
    assert json.loads((tmp_path / "s/reports/x.json").read_text()) == {"n": 2}
    assert not [p for p in (tmp_path / "s/reports").iterdir() if not p.name.endswith(("x.json", ".crc"))]


def window(spark, notes, *manual, now=NOW):
    return collection_window(spark, notes, clock.utc(now), *manual)


def test_windows_follow_the_cursor_and_report_gaps(spark):
    first = window(spark, {})
    assert first.start == first.floor == (NOW - timedelta(days=7)).replace(tzinfo=None) and first.gap_start is None and not first.manual
    far = {"initial_floor": "2026-07-01 00:00:00", "last_complete": "2026-09-01 00:00:00"}
    late = window(spark, far)
    assert (late.gap_start, late.gap_end, late.gap_reason) == (datetime(2026, 9, 1), (NOW - timedelta(days=14)).replace(tzinfo=None), "beyond_auto_lookback")
    manual = window(spark, far, "2026-09-01", "2026-09-02")
    assert manual.manual and manual.end == datetime(2026, 9, 2, 23, 59, 59, 999999) and manual.gap_start is None
    for bad in (("2026-09-02", "2026-09-01"), ("2026-09-01",), ("yesterday", "2026-09-01"), ("2026-09-01T00:00:00", "2026-09-02")):
        with pytest.raises(ValueError):
            window(spark, {}, *bad)


def test_only_complete_automatic_windows_move_the_cursor(spark, tmp_path):
    source = fixture(tmp_path)
    run, papers = start(spark, tmp_path, source)
    report = run.run(papers, coverage_complete=False, window=run.window())
    floor = str((NOW - timedelta(days=7)).replace(tzinfo=None))
    assert run.store.notes("papers") == {"initial_floor": floor} and "collection_incomplete" in report["errors"] and report["records"] == 4
    run, papers = start(spark, tmp_path, source, now=NOW + timedelta(hours=1))
    run.run(papers, window=run.window("2026-10-01", "2026-10-02"))
    assert run.store.notes("papers") == {"initial_floor": floor}
    run, papers = start(spark, tmp_path, source, now=NOW + timedelta(hours=2))
    run.run(papers, window=run.window())
    assert run.store.notes("papers") == {"initial_floor": floor, "last_complete": str((NOW + timedelta(hours=2)).replace(tzinfo=None))}
    late, papers = start(spark, tmp_path, source, now=NOW + timedelta(days=40))
    assert late.window().gap_reason == "beyond_auto_lookback" and "collection_gap_outside_lookback" in late.errors


def test_a_run_writes_changed_papers_only(spark, tmp_path):
    run, papers = start(spark, tmp_path, fixture(tmp_path))
    run.collect(papers)
    run.select()
    run.list_metadata()
    written = [spark.read.parquet(f"{run.store.root}/papers/{v}").count() for v in versions(run.store, "papers")]
    # Collected; decided; frozen with their decision; listed by their metadata (all but the rejected one).
    assert written == [4, 4, 4, 3] and run._papers().count() == 4
