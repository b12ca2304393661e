"""Mixing sources to target weights with DataFrame functions only.

Token counts are aggregated per source, targets are filled by weight under a cap per source, and every
document is taken floor(rate) times plus one copy drawn with probability equal to the fraction. The draw
is a hash of seed and doc_id, so reruns and lost executors give the same mix.

Nulls and edge cases: a null text has no words; rows with a null source form a source of their own, last in
order; rows with the same doc_id (or a null one) draw alike; empty tables give empty results; sources without
words have target 0 and are not taken. Extra columns are kept; names starting with `_mix_` are reserved.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scholarsieve.llm.common import small_enough

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    A source is full when its cap (`most` times its size) is below weight times the common level. In order of
    cap / weight the full sources come first, so running sums over the sources give every possible level, and
    the first one that no later source undercuts is the level. The windows run over one row per source.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weighted = sizes.withColumn("_mix_weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))).cast("int") + 1))
    tight = Window.orderBy(F.col("source_size") / F.col("_mix_weight"), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (weighted.withColumn("_mix_full", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most)
              .withColumn("_mix_open", F.sum("_mix_weight").over(every) - F.coalesce(F.sum("_mix_weight").over(before), F.lit(0)))
              .withColumn("_mix_level", (F.lit(float(share)) * F.sum("source_size").over(every) - F.col("_mix_full")) / F.col("_mix_open"))
              .withColumn("_mix_fits", F.col("_mix_level") * F.col("_mix_weight") <= F.col("source_size") * most))
    leveled = ranked.withColumn("_mix_rank", F.row_number().over(tight)).withColumn(
        "_mix_level", F.min_by("_mix_level", F.when(F.col("_mix_fits"), F.col("_mix_rank"))).over(every))
    cap = (F.col("source_size") * most).cast("double")
    return leveled.select("source", "source_size", F.least(cap, F.coalesce(F.col("_mix_level") * F.col("_mix_weight"), cap)).alias("target"))


def draw(seed: str, doc_id: Column) -> Column:
    """Uniform value in [0, 1) from a hash of the seed and the id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def copies(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """Every document with _mix_size, _mix_source_size, _mix_target and _mix_copies; none is left out."""
    sized = docs.withColumn("_mix_size", words(F.col("text")))
    per_source = sized.groupBy("source").agg(F.sum("_mix_size").alias("source_size"))
    goals = small_enough(targets(per_source, **options), 64).select(
        F.col("source").alias("_mix_source"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"))
    joined = sized.join(goals, F.col("source").eqNullSafe(F.col("_mix_source")), "left").drop("_mix_source")
    rate = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(0.0)
    return joined.withColumn("_mix_copies", (F.floor(rate) + (draw(seed, F.col("doc_id")) < rate - F.floor(rate)).cast("long")).cast("long"))


def mix(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns it had."""
    return (copies(docs, seed, **options)
            .withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), F.col("_mix_copies").cast("int")))).select(*(f"`{c}`" for c in docs.columns)))
