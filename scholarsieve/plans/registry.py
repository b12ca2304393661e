"""Registry of queries over the given tables, each with its independent SQL check."""
from __future__ import annotations

from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession

from scholarsieve.session import spread

QUERIES: dict = {}
CHECKS: dict = {}


def query(sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame under its own name."""
    def register(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            CHECKS[build.__name__] = dedent(sql)
        return build
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages", "conversations") else rows
