"""Batch twins of the streaming operators: the same transformations over a bounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import access, stats


def pid_stats(events: DataFrame) -> DataFrame:
    return stats.per_pid(stats.process_events(events))


def cold_pages(events: DataFrame, now: str, idle_days: int) -> DataFrame:
    return access.cold_pages(access.access_log(events), now, idle_days)


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """(user_id, start_ts, n) of sessions that end with a gap."""
    timed = events.where("user_id IS NOT NULL").withColumn("at", F.col("ts").cast("timestamp"))
    return timed.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select(
        "user_id", F.col("w.start").cast("timestamp_ntz").alias("start_ts"), "n")
