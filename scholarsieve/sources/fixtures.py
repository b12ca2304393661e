"""Scripted offline inputs: papers with decisions, bodies and summaries in one JSON file."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scholarsieve.functions import clock
from scholarsieve.operators import merge
from scholarsieve.schema import FIXTURE


class Fixture:
    """Tables of a fixture file; a missing entry is a failed stage, not a rejection."""

    def __init__(self, spark: SparkSession, path: str):
        self._doc = spark.read.schema(FIXTURE).option("multiLine", True).json(path)

    def papers(self) -> DataFrame:
        rows = self._doc.select(F.posexplode("papers").alias("arrival", "p")).select(F.col("arrival").cast("long"), "p.*")
        zoned = rows.withColumns({c: clock.parse_time(F.col(c)) for c in ("published", "updated")})
        return merge.canonical(zoned)

    def table(self, name: str, alias: str) -> DataFrame:
        """decisions, reviews, bodies, summaries or translations keyed by base_id."""
        return self._doc.select(F.explode(name).alias("base_id", alias))

    def translations(self, papers: DataFrame) -> DataFrame:
        """Supplied translations, else a marked placeholder so runs stay offline."""
        joined = papers.join(self.table("translations", "t"), "base_id", "left")
        return joined.select("base_id", F.coalesce("t.title_zh", F.concat(F.lit("离线标题译文："), "title")).alias("title_zh"),
                             F.coalesce("t.abstract_zh", F.concat(F.lit("离线摘要译文："), "abstract")).alias("abstract_zh"))
