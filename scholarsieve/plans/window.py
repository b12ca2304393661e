"""Collection windows: rolling lookback, first-run floor, reported gaps."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from scholarsieve.functions import clock


def plan_windows(states: DataFrame, now: Column, initial_days: int = 7, lookback_days: int = 14) -> DataFrame:
    """Next automatic window of every collection state.

    Columns: initial_floor and last_complete, both nullable UTC times. The floor is
    frozen by the first run. A gap older than the lookback is reported, not skipped.
    """
    if not (1 <= initial_days <= 7 and 1 <= lookback_days <= 14):
        raise ValueError("automatic windows are capped at 7 initial and 14 lookback days")
    floor = F.coalesce("initial_floor", now - F.expr(f"interval {initial_days} days"))
    planned = states.withColumn("floor", floor).withColumn("start", F.greatest("floor", now - F.expr(f"interval {lookback_days} days"))).withColumn("end", now)
    gap_from = F.when(F.col("last_complete") < F.col("start"), F.greatest("last_complete", "floor")) \
        .when(F.col("last_complete").isNull() & (F.col("floor") < F.col("start")), F.col("floor"))
    reason = F.when(F.col("last_complete") < F.col("start"), "beyond_auto_lookback").when(gap_from.isNotNull(), "initial_window_exceeded")
    return planned.withColumns({"gap_start": gap_from, "gap_end": F.when(gap_from.isNotNull(), F.col("start")), "gap_reason": reason})


def next_cursor(planned: DataFrame, complete: Column, manual: Column) -> DataFrame:
    """Only a complete automatic window moves the cursor."""
    return planned.withColumn("last_complete", F.when(complete & ~manual, F.col("end")).otherwise(F.col("last_complete")))


def collection_window(spark: SparkSession, notes: dict, now: Column, start: str | None = None, end: str | None = None, **days) -> Row:
    """Window of one run: start, end, floor, gap_start, gap_end, gap_reason, manual.

    `notes` hold the stored cursor (initial_floor, last_complete). A manual window needs both ends; a date as its end
    covers that whole day, and it has no gap. An end that is no time, or lies before the start, is an error.
    """
    if (start is None) != (end is None):
        raise ValueError("give both ends of a manual window, or none")
    stored = spark.createDataFrame([(notes.get("initial_floor"), notes.get("last_complete"), start, end)], "initial_floor string, last_complete string, s string, e string")
    states = stored.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("initial_floor", "last_complete")})
    planned = plan_windows(states, now, **days)
    if start is not None:
        none = F.lit(None)
        planned = planned.withColumns({"start": clock.moment(F.col("s")), "end": clock.moment(F.col("e"), end_of_day=True),
                                       "gap_start": none.cast("timestamp_ntz"), "gap_end": none.cast("timestamp_ntz"), "gap_reason": none.cast("string")})
    row = planned.select("start", "end", "floor", "gap_start", "gap_end", "gap_reason", F.lit(start is not None).alias("manual")).first()
    if row["start"] is None or row["end"] is None:
        raise ValueError("a manual window needs dates or times")
    if row["end"] < row["start"]:
        raise ValueError("manual end precedes start")
    return row


def moved_cursor(notes: dict, window: Row | None, complete: bool) -> dict:
    """Notes after a run: a complete automatic window moves the cursor, an automatic one fixes the floor if none is."""
    if window is None or window["manual"]:
        return notes
    floor = notes.get("initial_floor") or str(window["floor"])
    return {**notes, "initial_floor": floor, **({"last_complete": str(window["end"])} if complete else {})}
