"""Whole-table views of pages: the codec matrix, the best codec, file summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, scalar
from ..functions.constants import CODECS, MIN_SAVINGS_PCT, MIN_SAVINGS_RANGE, PAGE, SIZED, clamp


def size_columns(codecs=SIZED) -> list[str]:
    return [f"size_{c}" for c in codecs]


def codec_matrix(sized: DataFrame, *keys: str, codecs=SIZED) -> DataFrame:
    """A row for each page and codec: the sizes unpivoted, so no join is needed."""
    rows = sized.unpivot(list(keys), size_columns(codecs), "codec", "encoded_size")
    return rows.withColumn("codec", F.expr("substring(codec, 6)"))


def best_codec(sized: DataFrame, codecs=SIZED) -> DataFrame:
    """Adds best_algo and best_size: the least size, the first of a tie, else null."""
    ranked = F.array(*(F.struct(F.col(f"size_{c}").alias("size"), F.lit(k).alias("pos"), F.lit(CODECS[c]).alias("algo")) for k, c in enumerate(codecs)))
    best = F.array_min(F.filter(ranked, lambda x: x["size"].isNotNull()))
    return sized.withColumns({"best_algo": best["algo"], "best_size": best["size"]})


def profiled_best(pages: DataFrame, codecs=SIZED) -> DataFrame:
    """Profile, advice of both advisors, sizes and best codec of each page, in one pass over the bytes."""
    found = best_codec(kernels.with_features(pages, ["profile", *size_columns(codecs)]), codecs)
    return found.withColumns({
        "advised": scalar.advise_library(), "advised_kernel": scalar.advise_kernel()}).withColumn(
        "chosen", F.coalesce("best_algo", "advised"))


def worthwhile(best: DataFrame, min_pct: int = MIN_SAVINGS_PCT) -> DataFrame:
    """Pages that save at least so many whole hundredths."""
    return best.where(F.col("best_size").isNotNull() & (scalar.savings_pct("best_size") >= clamp(min_pct, MIN_SAVINGS_RANGE)))


def file_summary(best: DataFrame, *by: str) -> DataFrame:
    """Pages, incompressible pages, bytes, saved hundredths, and two ratios.

    ``ratio_ref`` leaves the code of incompressible pages out; ``ratio_net`` counts them as they are.
    """
    sums = best.groupBy(*by).agg(
        F.count("*").alias("pages"), F.count_if(F.col("best_size").isNull()).alias("incompressible"),
        F.coalesce(F.sum("best_size"), F.lit(0)).alias("packed_bytes"), F.sum(F.coalesce("best_size", F.lit(PAGE))).alias("net_bytes"))
    original = F.col("pages") * PAGE
    return sums.select(
        *by, "pages", "incompressible", original.alias("original_bytes"), "packed_bytes", "net_bytes",
        F.when(F.col("packed_bytes") > 0, F.round(original / F.col("packed_bytes"), 4)).alias("ratio_ref"),
        F.round(original / F.col("net_bytes"), 4).alias("ratio_net"),
        F.round(100 * (1 - F.col("net_bytes") / original), 4).alias("savings_pct"))
