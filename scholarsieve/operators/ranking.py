"""Ranking, quotas and running totals that stay flat when one group is huge.

A window over a whole group sorts it in one task. Here a quota is a cutoff key
found from at most k rows per group and map task (Spark's WindowGroupLimit runs
below the shuffle), and running totals are taken over range-partitioned cells.
All orders are one ascending struct column; descending numbers are negated. A null
group is a group like any other.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scholarsieve.session import cut_lineage, sized


def key(*columns) -> Column:
    return F.struct(*(c if isinstance(c, Column) else F.col(c) for c in columns))


def join_groups(left: DataFrame, right: DataFrame, group: list[str], how: str = "left") -> DataFrame:
    """Join on group columns where a null is a group like any other."""
    renamed = right.withColumnsRenamed({c: f"_g_{c}" for c in group})
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]
    return left.join(renamed, same, how).drop(*(f"_g_{c}" for c in group))


def kth(df: DataFrame, group: list[str], order: str, k: int, out: str = "_cutoff") -> DataFrame:
    """The k-th smallest order key of every group that has at least k rows."""
    ranked = df.select(*group, order).withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(order)))
    return ranked.where(F.col("_rank") == k).select(*group, F.col(order).alias(out))


def mark_quota(df: DataFrame, group: list[str], order: str, k: int, counts: Column | None = None,
               out: str = "within") -> DataFrame:
    """Flag rows up to and including the k-th row that counts; no row is moved or lost.

    `counts` selects the rows that use up a slot (default: every row). With
    counts = "the work succeeded" this is first-k-successes in rank order.
    """
    if k <= 0:
        return df.withColumn(out, F.lit(False))
    users = df if counts is None else df.where(counts)
    # At most one row per group.
    joined = join_groups(df, sized(kth(users, group, order, k)), group)
    return joined.withColumn(out, F.col("_cutoff").isNull() | (F.col(order) <= F.col("_cutoff"))).drop("_cutoff")


def fill_slots(queue: DataFrame, taken: DataFrame, group: list[str], order: str, k: int) -> DataFrame:
    """First rows of the queue for the slots that `taken` rows have left free in each group."""
    ranked = queue.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(order))).where(F.col("rank") <= k)
    used = taken.groupBy(*group).agg(F.count("*").alias("_used"))
    return join_groups(ranked, used, group).where(F.col("rank") <= k - F.coalesce("_used", F.lit(0))).drop("_used")


def running_totals(df: DataFrame, group: list[str], order: str, totals: dict[str, Column],
                   partitions: int | None = None) -> DataFrame:
    """Inclusive running totals per group in key order, for groups of any size.

    Rows are range-partitioned by (group, key); each (group, partition) cell is a
    contiguous run of its group. Cell totals (at most one row per partition and
    group) are accumulated, then each cell is summed on its own.
    The range-partitioned rows are checkpointed so both passes see the same cells
    even when executors are lost.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = df.withColumns({f"_v_{name}": value for name, value in totals.items()})
    cells = cut_lineage(staged.repartitionByRange(n, *group, order).withColumn("_cell", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (cells.groupBy(*group, "_cell").agg(*(F.sum(f"_v_{n_}").alias(f"_s_{n_}") for n_ in totals))
               .select(*group, "_cell", *(F.coalesce(F.sum(f"_s_{n_}").over(before), F.lit(0)).alias(f"_b_{n_}") for n_ in totals)))
    within = Window.partitionBy(*group, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = cells.withColumns({f"_w_{n_}": F.sum(f"_v_{n_}").over(within) for n_ in totals})
    joined = join_groups(summed, offsets, [*group, "_cell"], "inner")
    return (joined.withColumns({n_: F.col(f"_b_{n_}") + F.col(f"_w_{n_}") for n_ in totals})
            .drop("_cell", *(p + n_ for n_ in totals for p in ("_v_", "_s_", "_b_", "_w_"))))


def positions(df: DataFrame, group: list[str], order: str, out: str = "position") -> DataFrame:
    """Exact 1-based position of every row in its group."""
    return running_totals(df, group, order, {out: F.lit(1).cast("long")})
