"""Rolling collection as a stream: every micro-batch is one incremental re-scan.

Papers inside the lookback are screened and upserted; older ones are never dropped
silently but kept in a `late` table for manual backfill. Both writes can be repeated
for the same batch, so a batch replayed after a failure changes nothing.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from scholarsieve.plans.daily import DailyRun
from scholarsieve.sources.sinks import Store


def split_late(papers: DataFrame, now, lookback_days: int) -> tuple[DataFrame, DataFrame]:
    """(within the lookback, too old or without a time): every row is in one of them."""
    on_time = F.coalesce(F.col("published") >= now - F.expr(f"interval {int(lookback_days)} days"), F.lit(False))
    return papers.where(on_time), papers.where(~on_time)


def screen_batches(stream: DataFrame, make_run, store: Store, checkpoint: str, lookback_days: int = 14) -> StreamingQuery:
    """Start screening a stream of canonical paper rows (see `merge.canonical`) with an `arrival` column.

    `make_run()` returns a DailyRun on `store` for each batch; only its collection step is used,
    so discovery commits independently of later stages.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        run: DailyRun = make_run()
        on_time, late = split_late(batch, run.now, lookback_days)
        late.write.mode("overwrite").parquet(f"{store.root}/late/batch={batch_id}")
        run.collect(on_time)

    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
