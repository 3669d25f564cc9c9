"""The queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunk_dedup, decontaminate, jaccard_join, line_dedup, lm_score, packing, pii, quality, url_filter, vector_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.query,
        "op2_chunk_dedup": chunk_dedup.query,
        "op3_url_filter": url_filter.query,
        "op4_packing": packing.query,
        "op5_jaccard_join": jaccard_join.query,
        "op6_line_dedup": line_dedup.query,
        "op7_pii": pii.query,
        "op8_vector_dedup": vector_dedup.query,
        "op9_lm_score": lm_score.query,
        "op10_quality": quality.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": url_filter.SQL, "op5_jaccard_join": jaccard_join.SQL, "op6_line_dedup": line_dedup.SQL, "op8_vector_dedup": vector_dedup.SQL}
