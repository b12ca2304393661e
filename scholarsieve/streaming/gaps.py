"""Gaps of a collection stream: rows that arrive after their window was closed are reported, not dropped.

A window of publication times closes when the watermark (latest time of earlier batches less the lookback) passes
its end; an event-time timer then reports how many rows it had. Later rows of a closed window are a gap: their
number and times are kept in state and reported with every batch that adds to them. Busy windows are split into
`SPLITS` keys, whose counts `report` adds up, so that no task holds a whole window.

Output goes to one folder per batch, written anew when a batch is replayed; state comes from the checkpoint, so a
restart repeats neither rows nor counts.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from scholarsieve.session import sized

SPLITS = 16
ROW = "window_end long, split int, kind string, rows long, first_ms long, last_ms long"
_COUNT = "rows long, first_ms long, last_ms long"


def window_end_ms(published: Column, hours: int) -> Column:
    """End of the fixed window that holds a time, in milliseconds."""
    width = hours * 3_600_000
    return (F.floor(F.unix_millis(published.cast("timestamp")) / width) + 1) * width


class _Windows(StatefulProcessor):
    """Counts of one (window, split): rows before its close, and late ones after it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _COUNT)
        self.late = handle.getValueState("late", _COUNT)

    @staticmethod
    def _added(state, rows: pd.DataFrame):
        have = state.get() if state.exists() else (0, None, None)
        times = rows["published_ms"]
        found = (have[0] + len(rows), *(int(pick(times) if old is None else pick_two(old, pick(times)))
                                        for old, pick, pick_two in ((have[1], min, min), (have[2], max, max))))
        state.update(found)
        return found

    @staticmethod
    def _row(key, kind: str, found) -> pd.DataFrame:
        return pd.DataFrame([(int(key[0]), int(key[1]), kind, *map(int, found))], columns=["window_end", "split", "kind", "rows", "first_ms", "last_ms"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = int(key[0]) <= timerValues.getCurrentWatermarkInMs()
        found = None
        for part in rows:
            found = self._added(self.late if closed else self.open, part)
        if closed and found is not None:
            yield self._row(key, "gap", found)
        elif found is not None:
            self.handle.registerTimer(int(key[0]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            yield self._row(key, "closed", self.open.get())
            self.open.clear()

    def close(self) -> None:
        pass


def watch(stream: DataFrame, published: str, key: str, target: str, checkpoint: str, hours: int = 24, lookback_days: int = 14) -> StreamingQuery:
    """Start reporting closed windows and gaps of a stream under `target`; rows without a time are a gap of no window.

    Needs the RocksDB state store, which it asks for where the session names another one.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    watched = stream.select(F.col(published).cast("timestamp").alias("at"), F.col(key).alias("_key")).withWatermark("at", f"{int(lookback_days)} days")
    # The time goes on as a number: rows older than the watermark must reach the operator.
    keyed = watched.select(F.coalesce(window_end_ms(F.col("at"), hours), F.lit(0)).alias("window_end"), F.pmod(F.xxhash64("_key"), F.lit(SPLITS)).cast("int").alias("split"),
                           F.coalesce(F.unix_millis("at"), F.lit(0)).alias("published_ms"))
    rows = keyed.groupBy("window_end", "split").transformWithStateInPandas(_Windows(), outputStructType=ROW, outputMode="Append", timeMode="EventTime")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def report(spark: SparkSession, target: str) -> DataFrame:
    """Windows with their rows at closing and the gaps found since: the newest count of each split, added up."""
    latest = (spark.read.schema(ROW + ", batch long").parquet(target).groupBy("window_end", "split", "kind")
              .agg(*(F.max_by(c, "batch").alias(c) for c in ("rows", "first_ms", "last_ms"))))
    return latest.groupBy("window_end", "kind").agg(F.sum("rows").alias("rows"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))


def replay(arrivals: DataFrame, published: str, batch: str, hours: int = 24, lookback_days: int = 14) -> DataFrame:
    """Gaps of stored arrivals: what `watch` reports when their batches come one after another.

    Watermarks need one row per batch; every row then meets that of its own batch.
    """
    rows = arrivals.select(F.col(batch).alias("batch"), F.unix_millis(F.col(published).cast("timestamp")).alias("at"), window_end_ms(F.col(published), hours).alias("end"))
    latest = rows.groupBy("batch").agg(F.max("at").alias("at"))
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    marks = latest.select("batch", (F.max("at").over(before) - lookback_days * 86_400_000).alias("mark"))
    late = rows.join(sized(marks), "batch").where("coalesce(end, 0) <= greatest(mark, 0) AND mark IS NOT NULL")
    return late.groupBy(F.coalesce("end", F.lit(0)).alias("window_end")).agg(
        F.count("*").alias("rows"), F.coalesce(F.min("at"), F.lit(0)).alias("first_ms"), F.coalesce(F.max("at"), F.lit(0)).alias("last_ms"))
