"""Merge, caps, shards and windows."""
import json
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scholarsieve.operators import lab, merge
from scholarsieve.operators.rules import RuleSet
from scholarsieve.plans.window import plan_windows
from scholarsieve.sources import feed, scan

AT = datetime(2026, 10, 1)
ANY = RuleSet.of({"categories": [], "groups": {"G": ["medical"]}, "routes": {"r": [["G"]]}})
COLUMNS = ("version_id string, title string, abstract string, categories array<string>, published timestamp_ntz, updated timestamp_ntz, "
           "authors array<string>, pdf_url string, arrival long")


def paper(n, v=1, minute=0, updated=None, categories=("cs.CV",), authors=("A",), arrival=0, text="medical", pdf=""):
    return (f"2610.{n:05d}v{v}", f"Version {v}", text, list(categories), AT + timedelta(minutes=minute), updated or AT + timedelta(days=v), list(authors), pdf, arrival)


def frame(spark, rows):
    return merge.canonical(spark.createDataFrame(rows, COLUMNS))


def test_metadata_is_trimmed_and_distinct(spark):
    row = frame(spark, [paper(1, categories=("cs.CV", "cs.CV", "cs.AI"), authors=("A", " A ", "B"))]).first()
    assert (row.base_id, row.authors, row.categories, row.url) == ("2610.00001", ["A", "B"], ["cs.CV", "cs.AI"], "https://arxiv.org/abs/2610.00001v1")


def test_newest_version_wins_and_lists_are_united(spark):
    merged = merge.merge_versions(frame(spark, [paper(1, 1), paper(1, 2, authors=("B", "A"), categories=("cs.AI", "cs.CV"), arrival=1)])).first()
    assert (merged.version_id, merged.authors, merged.categories) == ("2610.00001v2", ["B", "A"], ["cs.AI", "cs.CV"])


def test_versions_compare_as_numbers_and_first_arrival_breaks_ties(spark):
    same = dict(updated=AT)
    rows = [paper(1, 10, authors=("B",), arrival=0, **same), paper(1, 9, arrival=1, pdf="p9", **same), paper(2, 3, arrival=2, text="first", **same), paper(2, 3, arrival=3, text="second", **same)]
    merged = {r.base_id: r for r in merge.merge_versions(frame(spark, rows)).collect()}
    assert merged["2610.00001"].version_id == "2610.00001v10" and merged["2610.00001"].pdf_url == "p9"
    assert merged["2610.00002"].abstract == "first"


def test_versions_are_screened_before_and_after_merging(spark):
    rows = [paper(1, 1, text="medical"), paper(1, 2, text="other", arrival=1), paper(2, 1, text="other", arrival=2)]
    known = spark.createDataFrame([], "base_id string")
    found = merge.collect(frame(spark, rows), ANY, known, 10).collect()
    assert [(r.version_id, r.routes) for r in found] == [("2610.00001v1", ["r"])]


def test_cap_counts_only_new_papers_and_stops_the_scan(spark):
    rows = [paper(n, arrival=n) for n in range(1, 6)]
    ids = lambda limit, known: sorted(r.base_id for r in merge.admit(frame(spark, rows), spark.createDataFrame([(k,) for k in known], "base_id string"), limit).collect())
    assert ids(2, []) == ["2610.00001", "2610.00002"]
    assert ids(2, ["2610.00001", "2610.00002"]) == [f"2610.0000{n}" for n in range(1, 5)]
    assert len(ids(5, [])) == 5 and ids(2, ["2610.00005"]) == ["2610.00001", "2610.00002"]


def test_lookup_by_id_keeps_request_order(spark):
    papers = frame(spark, [paper(1, 1), paper(1, 2, arrival=1), paper(2, 1, arrival=2)])
    wanted = spark.createDataFrame([(0, "2610.00002"), (1, "https://arxiv.org/abs/2610.00001v1"), (2, "2610.00001"), (3, "2610.00009"), (4, "2610.00002")], "ordinal int, requested string")
    assert [(r.identifier, r.version_id) for r in merge.by_ids(papers, wanted).collect()] == [
        ("2610.00002", "2610.00002v1"), ("2610.00001v1", "2610.00001v1"), ("2610.00001", "2610.00001v2"), ("2610.00009", None)]


def test_shards_split_until_every_part_fits(spark):
    papers = frame(spark, [paper(n, minute=n, arrival=n) for n in range(64)])
    audit = scan.shard_audit(papers, AT, AT + timedelta(minutes=64), ("cs.CV",), 10).collect()
    leaves = [s for s in audit if s.status == "complete"]
    assert {s.status for s in audit} == {"split", "complete"} and all(s.seen < 10 for s in leaves)
    covered = {m for s in leaves for m in range(64) if s.start <= AT + timedelta(minutes=m) <= s.end}
    assert covered == set(range(64))


def test_a_full_minute_splits_by_category_or_stays_incomplete(spark):
    papers = frame(spark, [paper(n, categories=("cs.CV",) if n % 2 else ("cs.AI",), arrival=n) for n in range(8)])
    both = scan.shard_audit(papers, AT, AT, ("cs.CV", "cs.AI"), 5).collect()
    assert [(s.status, s.categories) for s in both] == [("split", ["cs.CV", "cs.AI"]), ("complete", ["cs.CV"]), ("complete", ["cs.AI"])]
    assert [s.status for s in scan.shard_audit(papers, AT, AT, ("cs.CV",), 3).collect()] == ["shard_limit"]


def test_shard_work_is_bounded():
    audit, complete = scan.plan_shards(lambda *_: 10, AT, AT + timedelta(days=14), (), 10)
    assert not complete and sum(s.status != "unvisited" for s in audit) == 256


def test_window_bounds_reach_the_file_scan(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumnRenamed("ts", "published")
    plan = scan.window_scan(events, datetime(2024, 1, 2), datetime(2024, 1, 3)).select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan


@pytest.mark.parametrize("floor, last, start, gap", [
    (None, None, 13, None), (18, None, 18, None), (1, None, 6, (1, 6)), (1, 3, 6, (3, 6)), (1, 10, 6, None)])
def test_windows(spark, floor, last, start, gap):
    day = lambda n: None if n is None else datetime(2026, 10, n)
    states = spark.createDataFrame([(day(floor), day(last))], "initial_floor timestamp_ntz, last_complete timestamp_ntz")
    row = plan_windows(states, F.lit("2026-10-20").cast("timestamp_ntz")).first()
    assert row.start == day(start) and (row.gap_start, row.gap_end) == ((day(gap[0]), day(gap[1])) if gap else (None, None))


def test_snapshot_cache_is_reused_and_keyed(spark, tmp_path):
    calls = []

    def fetch():
        calls.append(1)
        return frame(spark, [paper(1, text="unrelated")])

    window = {"start": "a", "end": "b"}
    for expected in (False, True):
        rows, manifest, reused = scan.cached_snapshot(spark, str(tmp_path), window, ["cs.CV"], 10, fetch)
        assert reused is expected and rows.count() == 1 and manifest == {
            "schema": 1, "window": window, "categories": ["cs.CV"], "max_papers": 10, "complete": True}
    lab.check_coverage(manifest, ["cs.CV"], window)
    for wanted, dates in ((["cs.CV", "cs.AI"], window), (["cs.CV"], {"start": "a", "end": "c"})):
        with pytest.raises(ValueError):
            lab.check_coverage(manifest, wanted, dates)
    scan.cached_snapshot(spark, str(tmp_path), window, ["cs.AI"], 10, fetch)
    scan.cached_snapshot(spark, str(tmp_path), window, ["cs.CV"], 10, fetch, refresh=True)
    assert len(calls) == 3


def test_a_snapshot_that_says_something_else_is_no_hit(spark, tmp_path):
    window = {"start": "a", "end": "b"}
    rows = frame(spark, [paper(1)])
    _, manifest, _ = scan.cached_snapshot(spark, str(tmp_path), window, [], 10, lambda: (rows, False))
    path = scan.snapshot_path(str(tmp_path), window, [], 10)
    assert manifest["complete"] is False and scan.snapshot_manifest(spark, path) == manifest
    spark.createDataFrame([(json.dumps({**manifest, "max_papers": 11}),)], "value string").write.mode("overwrite").text(f"{path}.manifest")
    with pytest.raises(ValueError):
        scan.cached_snapshot(spark, str(tmp_path), window, [], 10, lambda: rows)
    assert scan.cached_snapshot(spark, str(tmp_path), window, [], 10, lambda: rows, refresh=True)[1]["complete"] is True


FEED_TIMES = [0, 0, 1, 5, 5, 5, 9, 30]


def fake_page(search, offset, size, delay):
    """A feed of one paper per entry of FEED_TIMES (minutes after AT), answering like the real one."""
    low, high = (datetime.strptime(x, "%Y%m%d%H%M") for x in re.search(r"\[(\d+) TO (\d+)\]", search).groups())
    held = [(n, AT + timedelta(minutes=m)) for n, m in enumerate(FEED_TIMES) if low <= AT + timedelta(minutes=m) <= high]
    entries = "".join(f"<entry><id>http://arxiv.org/abs/2610.{n:05d}v1</id><title>T{n}</title><summary>S</summary><published>{t:%Y-%m-%dT%H:%M:%SZ}</published>"
                      f"<updated>{t:%Y-%m-%dT%H:%M:%SZ}</updated><author><name>A</name></author></entry>" for n, t in held[offset:offset + size])
    return (f"<feed xmlns='http://www.w3.org/2005/Atom' xmlns:o='http://a9.com/-/spec/opensearch/1.1/'><o:totalResults>{len(held)}</o:totalResults>{entries}</feed>").encode()


def feed_options(**more):
    return {"start": AT.isoformat(), "transport": "tests.test_collection:fake_page", "shard_limit": "4", "page_size": "2", **more}


def test_the_feed_stream_resumes_and_arrivals_are_stable(spark, tmp_path):
    spark.dataSource.register(feed.PaperFeed)
    for until in (6, 6, 40):
        stream = spark.readStream.format("paper_feed").options(**feed_options(until=(AT + timedelta(minutes=until)).isoformat())).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    got = {(r.entry_id[-7:-2], r.arrival) for r in rows.collect()}
    assert len(got) == rows.select("entry_id").distinct().count() == len(FEED_TIMES)
    # Shards share their boundary minutes, so a batch read may repeat rows; the first arrival counts.
    again = spark.read.format("paper_feed").options(**feed_options(end=(AT + timedelta(minutes=5)).isoformat())).load()
    papers = merge.from_feed(again)
    first = lambda: sorted((r.base_id, r.arrival) for r in papers.groupBy("base_id").agg(F.min("arrival").alias("arrival")).collect())
    assert first() == first() and len(first()) == 6
    admitted = merge.admit(papers, spark.createDataFrame([], "base_id string"), 2)
    assert sorted({r.base_id for r in admitted.collect()}) == [base for base, _ in sorted(first(), key=lambda x: x[1])[:2]]


def test_long_windows_take_few_jobs(spark):
    papers = frame(spark, [paper(n, minute=n * 97 % 20_000, arrival=n) for n in range(400)])
    audit = scan.shard_audit(papers, AT, AT + timedelta(minutes=20_000), (), 10)
    rows = audit.collect()
    assert all(r.complete for r in rows) and sum(r.seen for r in rows if r.status == "complete") >= 400
    cut = scan.shard_audit(papers, AT, AT + timedelta(minutes=20_000), (), 1).collect()
    assert not any(r.complete for r in cut) and {"unvisited"} <= {r.status for r in cut}


def test_feed_pages_become_records(spark):
    xml = b"""<feed xmlns='http://www.w3.org/2005/Atom' xmlns:o='http://a9.com/-/spec/opensearch/1.1/'><o:totalResults>7</o:totalResults>
      <entry><id>http://arxiv.org/abs/2610.00001v2</id><title> T </title><summary> S </summary><published>2026-10-01T00:00:00Z</published><updated>2026-10-02T00:00:00Z</updated>
      <author><name>A</name></author><category term='cs.CV'/><link title='pdf' href='http://arxiv.org/pdf/2610.00001v2'/></entry></feed>"""
    total, rows = feed.parse_page(xml)
    row = merge.from_feed(spark.createDataFrame([(*r, 3) for r in rows], feed.FEED_SCHEMA)).first()
    assert total == 7 and row.arrival == 3 and (row.base_id, row.title, row.abstract, row.authors) == ("2610.00001", "T", "S", ["A"]) and row.updated == datetime(2026, 10, 2)
    assert feed.query(AT, AT + timedelta(minutes=5), ["cs.CV", "cs.AI"]) == "(cat:cs.CV OR cat:cs.AI) AND submittedDate:[202610010000 TO 202610010005]"
