"""Line dedup by overlapping windows of three lines.

Every three lines in a row are hashed to 128 bits. A window's first place is
the least (doc_id, text hash, line number) of all; wherever else it stands, its
three lines are covered, and the covered lines of a document are merged and
removed. A window of blank lines doesn't count.

Only DataFrame functions run. A window that stands in a third of all documents
is one row of the aggregate; the join back is one that Spark splits when skewed.

A text with fewer than three lines, an empty text and a null text stay as they
are (n_lines of a null text is null); a text of any length is cut into all its
lines. Repeated rows are the same document: each gets its result, and of documents
with equal windows the least doc_id keeps them. An empty table gives no rows. Extra
columns stay; ``n_lines`` and ``n_removed`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column, materialize

WINDOW = 3


def line_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, h, at, a, b): the two hashes of the window that starts at a line."""
    lines = docs.select("doc_id", "h", F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= WINDOW)
    three = F.transform(F.sequence(F.lit(0), F.size("lines") - WINDOW), lambda i: F.slice("lines", i + 1, WINDOW))
    # an outer explode: for the inner one the optimizer adds a filter that makes the windows once more
    return lines.select("doc_id", "h", F.posexplode_outer(three).alias("at", "w")).where(
        F.length(F.trim(F.array_join("w", ""))) > 0).select(
        "doc_id", "h", "at", F.xxhash64("w").alias("a"), F.xxhash64(F.lit(1), "w").alias("b"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs without the later occurrences, with n_lines and n_removed."""
    docs = docs.drop("n_lines", "n_removed")
    keyed = docs.withColumns({"__id": column(docs, "doc_id", "long"), "__h": F.xxhash64("text")})
    windows = line_windows(keyed.select(F.col("__id").alias("doc_id"), F.col("__h").alias("h"), "text"))
    firsts = windows.groupBy("a", "b").agg(
        F.min(F.struct("doc_id", "h", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first")
    # a table of its own, so that the join has a shuffle that Spark may split where a window is hot
    firsts = materialize(firsts, "firsts")
    later = windows.join(firsts, ["a", "b"]).where(~F.struct("doc_id", "h", "at").eqNullSafe(F.col("first")))
    covered = later.groupBy("doc_id", "h").agg(F.collect_set("at").alias("__at")).select(
        F.col("doc_id").alias("__doc"), F.col("h").alias("__hash"), "__at")
    joined = keyed.join(covered, F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__h") == F.col("__hash")), "left")
    gone = F.array_distinct(F.flatten(F.transform("__at", lambda p: F.array(p, p + 1, p + 2))))
    lines = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return joined.withColumns({
        "n_lines": F.when(F.col("text").isNotNull(), F.size(lines).cast("long")),
        "n_removed": F.when(F.col("__at").isNotNull(), F.size(gone)).otherwise(0).cast("long"),
        "text": F.when(F.col("__at").isNotNull(), text).otherwise(F.col("text")),
    }).select(*docs.columns, "n_lines", "n_removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
s AS (SELECT doc_id, ls, unnest(range(greatest(len(ls) - 2, 0))) AS i FROM d WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, ls[i + 1] AS a, ls[i + 2] AS b, ls[i + 3] AS c FROM s),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS k
    FROM w WHERE length(trim(a || b || c)) > 0) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM later),
lines AS (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM d WHERE text IS NOT NULL),
kept AS (
  SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS text
  FROM lines ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN n_removed IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""
