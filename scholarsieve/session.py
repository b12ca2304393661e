"""Session defaults and the shared checkpoint folder."""
from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "scholarsieve") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in spark.checkpoint.dir; survives lost executors.

    Only local mode may do without the setting: there every task sees the driver's folders.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="scholarsieve-ckpt-"))
    return df.checkpoint(eager=True)


def sized(side: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """A per-group side of a join, broadcast only when its size allows.

    The rows are materialized once and counted, so the other, large side needs no shuffle when the
    groups are few. Beyond `most_bytes` (rows times the width of their types) the join stays a
    shuffled one, where AQE splits hot partitions.
    """
    kept = cut_lineage(side)
    width = 8 + sum(_width(field.dataType) for field in kept.schema)
    return F.broadcast(kept) if kept.count() * width <= most_bytes else kept


def _width(kind: T.DataType) -> int:
    """Bytes assumed for a value of this type."""
    if isinstance(kind, T.StructType):
        return sum(_width(field.dataType) for field in kind)
    return 64 if isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)) else 8


def spread(table: DataFrame, small: int = 1 << 30) -> DataFrame:
    """Share a small table that sits in fewer files than there are cores among all tasks.

    Text work is CPU-bound, and a file with a single row group is read by one task.
    Tables above `small` bytes, or with enough files, are returned as they are.
    """
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if size <= small and len(table.inputFiles()) < cores else table
