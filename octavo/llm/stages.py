"""The operators as filters of a corpus: documents in, documents out.

Every stage returns the columns that it was given, whatever they are called. A
null text is an empty one here: the classifier scores it by its bias, and the
other stages keep it. Texts of any length are judged as wholes. Repeated rows are
judged alike, and so stay or go together; of linked documents with different ids
the least id stays, so there are no ties. Rows without a doc_id have no label and
are linked with nothing. An empty table, an empty benchmark and a table of labels
without rows give the documents as they are, or none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, line_dedup, packing, quality

#: Near duplicates: words of a shingle, and the least similarity in hundredths.
SHINGLE, PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; without any labels there is nothing to reject by, and all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    if labels.where("doc_id is not null and quality is not null").isEmpty():
        return docs
    model = quality.train(docs, labels)
    return quality.score(docs, model).where(f"score >= {quality.THRESHOLD}").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stood in an earlier window; those of which nothing is left go, and ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs)
    out = out.where("n_removed = 0 OR length(trim(text)) > 0")
    if "n_chars" in docs.columns:
        now = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, now).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id; documents without words stay."""
    return jaccard_join.representatives(docs, SHINGLE, PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, whole or in parts that cover half of it."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left; a document without text is one end token."""
    return packing.pack(docs)
