"""Windowed metadata scans, shard planning and the cached raw snapshot."""
from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from scholarsieve.config import fingerprint
from scholarsieve.functions import clock
from scholarsieve.session import cut_lineage

# Shard work limits.
MAX_SHARDS, MAX_DEPTH = 256, 24


def window_scan(papers: DataFrame, start: datetime, end: datetime, categories=()) -> DataFrame:
    """Inclusive exact window; plain comparisons so the bounds reach the Parquet scan."""
    kept = papers.where((F.col("published") >= clock.utc(start)) & (F.col("published") <= clock.utc(end)))
    return kept.where(F.arrays_overlap("categories", F.array(*map(F.lit, categories)))) if categories else kept


@dataclass
class Shard:
    start: datetime
    end: datetime
    categories: tuple
    depth: int
    status: str = "pending"
    seen: int = 0


def _halves(s: Shard) -> list[Shard]:
    minutes = int((s.end - s.start).total_seconds() // 60)
    if minutes >= 1:
        # Both bounds are inclusive minutes, so halves share their boundary.
        middle = s.start + timedelta(minutes=minutes // 2)
        spans = [(s.start, s.start), (s.end, s.end)] if minutes == 1 else [(s.start, middle), (middle, s.end)]
        return [Shard(a, b, s.categories, s.depth + 1) for a, b in spans]
    cut = len(s.categories) // 2
    return [Shard(s.start, s.end, part, s.depth + 1) for part in (s.categories[:cut], s.categories[cut:])] if cut else []


def plan_shards(count, start: datetime, end: datetime, categories: tuple, shard_limit: int) -> tuple[list[Shard], bool]:
    """Bisect time, then categories, until every shard stays below the source's row limit.

    `count(start, end, categories)` is the number of rows a shard would return.
    Returns the audit of all shards and whether the window is fully covered.
    """
    waiting, audit, complete = [Shard(start, end, tuple(categories), 0)], [], True
    while waiting:
        if len(audit) >= MAX_SHARDS:
            for left in waiting:
                left.status = "unvisited"
            return audit + waiting, False
        shard = waiting.pop()
        audit.append(shard)
        shard.seen = min(count(shard.start, shard.end, shard.categories), shard_limit)
        if shard.seen < shard_limit:
            shard.status = "complete"
            continue
        halves = _halves(shard)
        if halves and shard.depth < MAX_DEPTH:
            shard.status = "split"
            waiting.extend(reversed(halves))
        else:
            shard.status, complete = "shard_limit", False
    return audit, complete


def _family(shard: Shard, levels: int) -> list[Shard]:
    """A shard with what it may be split into, by time only."""
    found = level = [shard]
    for _ in range(levels):
        level = [half for s in level if s.end > s.start for half in _halves(s)]
        found = found + level
    return found


def shard_audit(papers: DataFrame, start: datetime, end: datetime, categories: tuple, shard_limit: int, levels: int = 5) -> DataFrame:
    """Shard plan for a stored table, with `complete`: does the plan cover the whole window?

    Rows are counted per minute on the cluster; the driver only gets the counts of shards it asks for, those of a
    shard and of `levels` further splits in one job, so the plan takes few jobs and at most `MAX_SHARDS` decisions,
    whatever the window's length. Shards narrower than the category list, which exist only for a single saturated
    minute, are counted by a job of their own.
    """
    spark, whole = papers.sparkSession, tuple(categories)
    per_minute = cut_lineage(window_scan(papers, start, end, categories).groupBy(clock.minute(F.col("published")).alias("m")).agg(F.count("*").alias("n")))
    known: dict = {}

    def count(lo, hi, cats):
        if cats != whole:
            return window_scan(papers, max(lo, start), min(hi + timedelta(minutes=1, microseconds=-1), end), cats).count()
        if (lo, hi) not in known:
            spans = sorted({(s.start, s.end) for s in _family(Shard(lo, hi, whole, 0), levels)})
            sums = (F.sum(F.when(F.col("m").between(clock.utc(a), clock.utc(b)), F.col("n"))).alias(f"n{i}") for i, (a, b) in enumerate(spans))
            known.update(zip(spans, (n or 0 for n in per_minute.agg(*sums).first())))
        return known[lo, hi]

    audit, complete = plan_shards(count, start.replace(second=0, microsecond=0), end.replace(second=0, microsecond=0), whole, shard_limit)
    rows = [(s.start, s.end, list(s.categories), s.depth, s.status, s.seen, complete) for s in audit]
    return spark.createDataFrame(rows, "start timestamp_ntz, end timestamp_ntz, categories array<string>, depth int, status string, seen long, complete boolean")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


SNAPSHOT_SCHEMA = 1


def _described(window: dict, categories, cap: int) -> dict:
    return {"schema": SNAPSHOT_SCHEMA, "window": window, "categories": sorted(set(categories)), "max_papers": cap}


def snapshot_path(root: str, window: dict, categories, cap: int) -> str:
    return f"{root.rstrip('/')}/{fingerprint(_described(window, categories, cap))[:24]}"


def snapshot_manifest(spark: SparkSession, path: str) -> dict | None:
    """What a snapshot says of itself; null for one that was not finished."""
    target = f"{path}.manifest"
    return json.loads("\n".join(r[0] for r in spark.read.text(target).collect())) if _exists(spark, f"{target}/_SUCCESS") else None


def cached_snapshot(spark: SparkSession, root: str, window: dict, categories, cap: int, fetch, refresh: bool = False) -> tuple[DataFrame, dict, bool]:
    """(raw rows, manifest, reused) for one (window, categories, cap); rule changes reuse them.

    `fetch()` gives the rows, or the rows and whether they cover the window. Non-matching rows are kept: widening a rule
    must not need another fetch. The manifest beside the data names window, categories, cap and coverage; it is written
    last, and one that does not fit the request is an error, not a hit. `lab.check_coverage` takes it.
    """
    path, asked = snapshot_path(root, window, categories, cap), _described(window, categories, cap)
    manifest = None if refresh else snapshot_manifest(spark, path)
    if manifest is not None:
        if any(manifest.get(name) != value for name, value in asked.items()):
            raise ValueError("the stored snapshot is of another experiment: fetch it again with refresh=True")
        return spark.read.parquet(path), manifest, True
    fetched = fetch()
    rows, complete = fetched if isinstance(fetched, tuple) else (fetched, True)
    rows.write.mode("overwrite").parquet(path)
    manifest = {**asked, "complete": complete}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").write.mode("overwrite").text(f"{path}.manifest")
    return spark.read.parquet(path), manifest, False
