"""Corpus pipeline: toxic documents go, near-duplicates keep one, leaks go, sources are mixed, ids are written."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scholarsieve.llm import decontamination, minhash, mixing, tokens, toxicity
from scholarsieve.llm.common import bound_batches, stored


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on labelled rows of `docs`."""
    bound_batches(spark)
    return toxicity.clean(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8 or more."""
    bound_batches(spark)
    return minhash.keep_one(docs, width=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    bound_batches(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: place, length and checksum of every document."""
    bound_batches(spark)
    return tokens.read_digest(tokens.write_files(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("toxicity", toxic_out), ("near_dedup", near_dedup), ("decontamination", decontaminate),
          ("mixing", mix_sources), ("token_ids", token_ids)]

#: Learned scores, signatures and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
