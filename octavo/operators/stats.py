"""Counters by process and owner, and latency summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import MOST_PIDS, PAGE, TOP_N, checked_top_n


def process_events(events: DataFrame) -> DataFrame:
    """(ts, event_id, pid, uid, comm, op, bytes_saved, ns) of an events table."""
    return events.select(
        "ts", "event_id", F.col("user_id").alias("pid"), (F.col("user_id") % 5).alias("uid"), F.substring("event_type", 1, 15).alias("comm"),
        F.when(F.col("event_type").isin("click", "view"), "decompress").otherwise("compress").alias("op"),
        F.floor("value").cast("bigint").alias("bytes_saved"), (100 + F.col("event_id") % 900).alias("ns"))


def _sums() -> list:
    packed = F.col("op") == "compress"
    return [
        F.count_if(packed).alias("pages_compressed"), F.count_if(~packed).alias("pages_decompressed"),
        F.coalesce(F.sum(F.when(packed, F.col("bytes_saved"))), F.lit(0)).alias("bytes_saved"),
        F.coalesce(F.sum(F.when(packed, F.col("ns"))), F.lit(0)).alias("compress_ns"),
        F.coalesce(F.sum(F.when(~packed, F.col("ns"))), F.lit(0)).alias("decompress_ns"),
    ]


def per_pid(ops: DataFrame) -> DataFrame:
    """Five counters for each process, with the name of its first event."""
    return ops.groupBy("pid").agg(
        F.min_by("uid", F.struct("ts", "event_id")).alias("uid"), F.min_by("comm", F.struct("ts", "event_id")).alias("comm"), *_sums())


def whole_average(total: str, count: str) -> F.Column:
    """Integer average; 0 for a count of 0."""
    return F.expr(f"coalesce({total} div nullif({count}, 0), 0)")


def uid_summary(ops: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """The owners that saved most; ties by uid. Without a shuffle of the processes: partial sums go by owner at once."""
    by_uid = ops.groupBy("uid").agg(*_sums())
    return by_uid.select(
        "uid", "bytes_saved", "pages_compressed", "pages_decompressed",
        whole_average("compress_ns", "pages_compressed").alias("avg_compress_ns"),
        whole_average("decompress_ns", "pages_decompressed").alias("avg_decompress_ns")).orderBy(F.desc("bytes_saved"), "uid").limit(checked_top_n(top_n))


def first_pids(ops: DataFrame, most: int = MOST_PIDS) -> DataFrame:
    """The pids that came first, up to a bound: later ones have no counters."""
    seen = ops.groupBy("pid").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return seen.orderBy("first").limit(most).select("pid")


def capped(ops: DataFrame, most: int = MOST_PIDS) -> DataFrame:
    return per_pid(ops.join(F.broadcast(first_pids(ops, most)), "pid", "left_semi"))


def live_only(stats: DataFrame, live: DataFrame) -> DataFrame:
    """Garbage collection: the counters of processes that live."""
    return stats.join(live, "pid", "left_semi")


def global_gauges(ops: DataFrame) -> DataFrame:
    return ops.agg(*_sums(), F.countDistinct("pid").alias("processes"))


#: Parts of a bucket, and how often the one with the rank is cut, before its distinct values are ranked.
SUB, CUTS = 4096, 1


def latency_summary(samples: DataFrame, *by: str, width: float = 1.0) -> DataFrame:
    """Percentiles p50, p95, p99 at the lower nearest rank int(p/100 * (n-1)), mean, min, max, total and count of ``latency_ns``.

    Exact, and no task orders more than some thousand rows: counts of buckets by
    order of magnitude (eighths of a power of two, from ``width`` on) give the bucket
    that holds each rank; that one is cut into equal parts between its least and
    greatest value, and only the distinct values of the part are ranked.
    """
    keys = list(by)
    level = F.floor(F.log2(1 + F.abs("latency_ns") / width) * 8)
    samples = samples.where("latency_ns IS NOT NULL").withColumn("bucket", F.when(F.col("latency_ns") < 0, -1 - level).otherwise(level))
    over = ("PARTITION BY " + ", ".join(keys)) if keys else ""
    buckets = samples.groupBy(*keys, "bucket").agg(F.count("*").alias("c"), F.min("latency_ns").alias("lo"), F.max("latency_ns").alias("hi")).selectExpr(
        *keys, "bucket", "c", "lo", "hi", f"sum(c) OVER ({over} ORDER BY bucket) - c AS before", f"sum(c) OVER ({over}) AS n")
    ranks = buckets.withColumn("p", F.explode(F.array(*(F.lit(x) for x in (50, 95, 99))))).withColumn(
        "rank", F.expr("int(p / 100D * (n - 1))")).where("rank >= before AND rank < before + c").select(*keys, "bucket", "p", "rank", "before", "lo", "hi")
    for _ in range(CUTS):
        part = F.expr(f"IF(hi > lo, int((latency_ns - lo) / (hi - lo) * {SUB - 1}), 0)")
        cut = _inside(samples, ranks, keys).withColumn("part", part).groupBy(*keys, "bucket", "p", "rank", "before", "part").agg(
            F.count("*").alias("c"), F.min("latency_ns").alias("lo"), F.max("latency_ns").alias("hi"))
        ranks = cut.selectExpr(*keys, "bucket", "p", "rank", "lo", "hi", "c", f"before + sum(c) OVER (PARTITION BY {', '.join([*keys, 'p'])} ORDER BY part) - c AS before").where(
            "rank >= before AND rank < before + c").drop("c")
    values = _inside(samples, ranks, keys).groupBy(*keys, "p", "rank", "before", "latency_ns").agg(F.count("*").alias("c")).selectExpr(
        *keys, "p", "rank", "latency_ns", "c", f"before + sum(c) OVER (PARTITION BY {', '.join([*keys, 'p'])} ORDER BY latency_ns) - c AS before")
    found = values.where("rank >= before AND rank < before + c")
    at = [F.max(F.when(F.col("p") == p, F.col("latency_ns"))).alias(f"p{p}") for p in (50, 95, 99)]
    totals = samples.groupBy(*keys).agg(
        F.avg("latency_ns").alias("mean_ns"), F.min("latency_ns").alias("min_ns"), F.max("latency_ns").alias("max_ns"),
        F.sum("latency_ns").alias("total_ns"), F.count("*").alias("n"))
    quantiles = found.groupBy(*keys).agg(*at)
    return quantiles.join(totals, keys) if keys else quantiles.crossJoin(totals)


def _inside(samples: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """The samples that lie in the range of a rank, with it."""
    return samples.join(ranks, [*keys, "bucket"]).where("latency_ns BETWEEN lo AND hi")


def running(df: DataFrame, key: str, order: list[str], slice_: str, **values: str) -> DataFrame:
    """Adds running sums of values by key, in order; ``slice_`` cuts the order into parts, so that a hot key is many tasks.

    Within a part rows are summed in order; the totals of the parts before are added.
    """
    cut = df.selectExpr("*", f"{slice_} AS __slice", *(f"{v} AS __{n}" for n, v in values.items()))
    totals = cut.groupBy(key, "__slice").agg(*(F.sum(f"__{n}").alias(f"__{n}") for n in values)).selectExpr(
        f"{key} AS __key", "__slice AS __of", *(f"sum(__{n}) OVER (PARTITION BY {key} ORDER BY __slice) - __{n} AS __before_{n}" for n in values))
    own = cut.selectExpr("*", *(f"sum(__{n}) OVER (PARTITION BY {key}, __slice ORDER BY {', '.join(order)} ROWS UNBOUNDED PRECEDING) AS __own_{n}" for n in values))
    same = F.col(key).eqNullSafe(F.col("__key")) & F.col("__slice").eqNullSafe(F.col("__of"))
    return own.join(totals, same).select(*(F.col(c) for c in df.columns), *((F.col(f"__own_{n}") + F.col(f"__before_{n}")).alias(n) for n in values))


def first_errors(results: DataFrame, *by: str) -> DataFrame:
    """(by, items, failed, first_error): the first status that isn't zero by place; one of a lookup (-2) goes before one of decoding."""
    failed = F.col("status") != 0
    place = F.when(failed, F.struct(F.col("status") != -2, "place"))
    return results.groupBy(*by).agg(
        F.count("*").alias("items"), F.count_if(failed).alias("failed"), F.coalesce(F.min_by(F.when(failed, F.col("status")), place), F.lit(0)).alias("first_error"))


def parallel_stats(clusters: DataFrame) -> DataFrame:
    """Totals of clusters that were decoded: clusters, pages, failures and the codes' bytes."""
    return clusters.agg(F.count("*").alias("clusters"), F.coalesce(F.sum(F.col("items") - F.col("failed")), F.lit(0)).alias("pages"),
                        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def stat_views(ops: DataFrame, flags: DataFrame, stored: DataFrame) -> DataFrame:
    """One row of scalar statistics: counters and averages, the pool, and the scanner with its reasons."""
    counters = ops.agg(*_sums()).select(
        "pages_compressed", "pages_decompressed", "bytes_saved", F.col("compress_ns").alias("compress_ns_total"), F.col("decompress_ns").alias("decompress_ns_total"),
        whole_average("compress_ns", "pages_compressed").alias("compress_avg_ns"), whole_average("decompress_ns", "pages_decompressed").alias("decompress_avg_ns"))
    pool = stored.agg(F.count("*").alias("zswap_pages"), F.coalesce(F.sum("compressed_len"), F.lit(0)).alias("zswap_bytes"),
                      F.coalesce(F.sum(F.lit(PAGE) - F.col("compressed_len")), F.lit(0)).alias("zswap_saved"))
    ok = "is_anon AND NOT is_locked AND NOT is_shared AND NOT is_io AND refcount <= 2"
    scanner = flags.agg(
        F.count("*").alias("scanner_pages_scanned"), F.count_if(F.expr(ok)).alias("scanner_mark_pages"), F.count_if(F.expr(f"NOT ({ok})")).alias("scanner_pages_skipped"),
        F.count_if(F.expr("is_anon AND NOT is_io AND is_locked")).alias("scanner_skip_page_mlocked"),
        F.count_if(F.expr("is_anon AND NOT is_io AND NOT is_locked AND is_shared")).alias("scanner_skip_page_shared"))
    return counters.crossJoin(pool).crossJoin(scanner)
