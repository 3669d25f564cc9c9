"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes what the one before kept. The first four return documents with
the columns they came with; the last returns the pieces of the sequences. What the
stages do with nulls, empty and long texts, ties, repeated rows and empty tables is
told in ``octavo.llm.stages``; no table of documents makes a stage fail.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from octavo.llm import stages
from octavo.llm.shared import delete, scratch_scope, shared_dir
from octavo.session import ship


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.keep_good(ship(spark), docs, sf_dir)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.drop_lines(ship(spark), docs, sf_dir)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.drop_near_copies(ship(spark), docs, sf_dir)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.drop_contaminated(ship(spark), docs, sf_dir)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.pack(ship(spark), docs, sf_dir)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: The classifier, the tilings and the packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written as Parquet and read again.

    What a stage wrote for itself, and the results before the last, are deleted as soon as they aren't needed.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs
