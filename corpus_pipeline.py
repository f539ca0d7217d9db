"""The corpus pipeline: stages over ``documents``, each written before the next one reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from twinframe.llm import decontamination, near_dedup, pii, quality_rules, segmentation
from twinframe.session import work_root


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs."""
    return quality_rules.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    return near_dedup.deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontamination.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with tags in the place of personal data."""
    return pii.redacted(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, rank, score, n_pieces, ids, round_trip``: the best segmentations of each document, as many as the operator
    gives."""
    return segmentation.segmentations(docs)


STAGES = [
    ("quality rules", quality), ("near duplicates", near_duplicates), ("benchmark decontamination", benchmark),
    ("personal data", personal_data), ("pieces", pieces),
]
#: Personal data and pieces are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is a Parquet table in the shared work folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{work_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
