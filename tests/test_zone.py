"""Windows and runs give the same rows in any session time zone."""
from datetime import datetime, timezone

from scholarsieve.functions import clock
from scholarsieve.plans.catalogue import QUERIES


def test_literals_and_windows_ignore_the_session_zone(spark, sf):
    names = ("collection_window", "shard_plan", "plan_window_gaps", "lab_screen_snapshot")
    before = {n: sorted(map(str, QUERIES[n](spark, sf).collect())) for n in names}
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert {n: sorted(map(str, QUERIES[n](spark, sf).collect())) for n in names} == before
        shown = spark.range(1).select(clock.utc(datetime(2026, 10, 1, 8, tzinfo=timezone.utc)).cast("string").alias("t")).first().t
        assert shown == "2026-10-01 08:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
