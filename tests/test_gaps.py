"""Late rows of a stream: windows close by timers, gaps are reported once, restarts repeat nothing."""
import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from scholarsieve.streaming import gaps

DAY = datetime(2026, 10, 1, tzinfo=timezone.utc)
BATCHES = [[0, 0.2, 1], [9, 9.5, 1.5], [1.7, 0.1, 9.9, 8], [20, 0.3, 1.9, 9.1], [30], [2, 21]]


def arrivals():
    return [(b, i, (DAY + timedelta(days=d)).isoformat()) for b, days in enumerate(BATCHES) for i, d in enumerate(days)]


def put(folder, batches):
    for b, i, at in arrivals():
        if b in batches:
            (folder / f"{b:03d}-{i}.json").write_text(json.dumps({"id": f"{b}-{i}", "at": at, "batch": b}))


def drain(spark, source, target, checkpoint):
    stream = spark.readStream.schema("id string, at timestamp, batch int").option("maxFilesPerTrigger", 100).json(str(source))
    gaps.watch(stream, "at", "id", str(target), str(checkpoint), hours=24, lookback_days=5).awaitTermination()


def rows(spark, target, kind):
    return {r.window_end: (r["rows"], r.first_ms, r.last_ms) for r in gaps.report(spark, str(target)).where(F.col("kind") == kind).collect()}


def test_gaps_survive_restarts_and_match_the_replay(spark, tmp_path):
    source, target, checkpoint = (tmp_path / n for n in ("in", "out", "ckpt"))
    source.mkdir()
    for b in range(len(BATCHES)):
        put(source, {b})
        drain(spark, source, target, checkpoint)  # every batch is a new query on the same checkpoint
    drain(spark, source, target, checkpoint)  # nothing new
    stored = spark.createDataFrame(arrivals(), "batch int, i int, at string").withColumn("at", F.to_timestamp("at"))
    want = {r.window_end: (r["rows"], r.first_ms, r.last_ms) for r in gaps.replay(stored, "at", "batch", 24, 5).collect()}
    assert rows(spark, target, "gap") == want and sum(n for n, *_ in want.values()) == 6
    on_time = rows(spark, target, "closed")
    end = lambda day: int((DAY + timedelta(days=day + 1)).timestamp() * 1000)
    # Everything up to the last watermark (day 25) is closed or late, each row once.
    assert sum(n for n, *_ in on_time.values()) + 6 == sum(len(b) for b in BATCHES) - 1
    assert on_time[end(0)][0] == 2 and want[end(0)][0] == 2 and want[end(21)][0] == 1 and end(21) not in on_time


def test_rows_without_a_time_belong_to_no_window(spark):
    stored = spark.createDataFrame([(0, None), (1, DAY), (2, None)], "batch int, at timestamp")
    assert [(r.window_end, r["rows"]) for r in gaps.replay(stored, "at", "batch", 24, 5).collect()] == [(0, 1)]
    assert gaps.replay(stored.limit(0), "at", "batch").count() == 0
