"""Result sinks: CSV with a header, one JSON document a file, key and value text, a process table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """A result object a line, which any number of tasks can write."""
    df.write.json(path)


def results_document(df: DataFrame) -> DataFrame:
    """One row ``{"results": [...]}``; for summaries, whose rows are few."""
    return df.agg(F.to_json(F.struct(F.collect_list(F.struct(*df.columns)).alias("results"))).alias("value"))


def key_values(df: DataFrame) -> DataFrame:
    """The columns of a row of statistics as (key, value) rows."""
    return df.unpivot([], df.columns, "key", "value")


def process_table(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("sep", "\t").csv(path)
