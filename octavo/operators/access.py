"""Idle pages from access logs, adaptive scanning, tiers and device buffers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.constants import DECAY_EPOCH, INTERVAL_MOST_MS, INTERVAL_STEP_MS, PFN_BATCH, SKIP_SLOTS

KEY = ["owner_id", "page_index"]


def access_log(events: DataFrame) -> DataFrame:
    """(ts, owner_id, page_index): an event touches one of its user's 64 pages."""
    return events.select("ts", F.col("user_id").alias("owner_id"), (F.col("event_id") % 64).alias("page_index"))


def page_flags(events: DataFrame) -> DataFrame:
    """Flags of every page that the log knows, from a rule."""
    return events.select(F.col("user_id").alias("owner_id"), (F.col("event_id") % 64).alias("page_index")).distinct().selectExpr(
        "owner_id", "page_index", "(owner_id + page_index) % 7 <> 0 AS is_anon", "(owner_id * 3 + page_index) % 11 = 0 AS is_locked",
        "(owner_id + page_index * 5) % 13 = 0 AS is_shared", "(owner_id + page_index) % 17 = 0 AS is_io", "int((owner_id + page_index) % 4) AS refcount")


def eligible(flags: DataFrame) -> DataFrame:
    return flags.where("is_anon AND NOT is_locked AND NOT is_shared AND NOT is_io AND refcount <= 2")


def skip_reasons(flags: DataFrame) -> DataFrame:
    """How many pages each test keeps out, in the order of the tests."""
    reason = F.expr("""CASE WHEN NOT is_anon THEN 'not_anon' WHEN is_io THEN 'io' WHEN is_locked THEN 'locked'
        WHEN is_shared THEN 'shared' WHEN refcount > 2 THEN 'refcount' ELSE 'eligible' END""")
    return flags.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def region_flags(events: DataFrame) -> DataFrame:
    """Flags of the regions of 16 pages that the log knows, from a rule."""
    return events.select(F.col("user_id").alias("owner_id"), F.expr("event_id % 64 div 16").alias("region")).distinct().selectExpr(
        "owner_id", "region", "(owner_id + region) % 5 <> 0 AS is_anon", "(owner_id * 7 + region) % 13 = 0 AS is_pfnmap", "(owner_id + region * 3) % 11 = 0 AS is_io",
        "(owner_id * 3 + region) % 7 = 0 AS is_locked", "(owner_id + region) % 9 = 0 AS is_shared")


def eligible_regions(regions: DataFrame) -> DataFrame:
    """Regions that a scan enters at all."""
    return regions.where("is_anon AND NOT is_pfnmap AND NOT is_io AND NOT is_locked AND NOT is_shared")


def page_states(events: DataFrame) -> DataFrame:
    """What a scan sees of each page, from a rule."""
    return events.select(F.col("user_id").alias("owner_id"), (F.col("event_id") % 64).alias("page_index")).distinct().selectExpr(
        "owner_id", "page_index", "(owner_id + page_index * 3) % 19 <> 0 AS is_present", "(owner_id * 5 + page_index) % 23 = 0 AS is_compound", "(owner_id + page_index) % 7 <> 0 AS is_anon",
        "(owner_id * 2 + page_index) % 9 <> 0 AS is_lru", "(owner_id * 3 + page_index) % 11 = 0 AS is_mlocked", "int((owner_id + page_index) % 4) AS refcount")


#: Why a page isn't taken, in the order of the tests.
_SKIPPED = """CASE WHEN NOT is_present THEN 'absent' WHEN is_compound THEN 'compound' WHEN NOT is_anon THEN 'not_anon' WHEN NOT is_lru THEN 'not_lru'
    WHEN is_mlocked THEN 'mlocked' WHEN refcount > 2 THEN 'shared' ELSE 'eligible' END"""


def eligible_states(states: DataFrame) -> DataFrame:
    return states.where(f"{_SKIPPED} = 'eligible'").select(*KEY)


def state_reasons(states: DataFrame) -> DataFrame:
    return states.groupBy(F.expr(_SKIPPED).alias("reason")).agg(F.count("*").alias("n"))


def next_batch(log: DataFrame, cursors: DataFrame, size: int = PFN_BATCH, key: str = "pid") -> DataFrame:
    """The next rows of each key after its cursor (key, last): a scan goes on where it stopped.

    ``log`` has the key, ``ts`` and ``event_id``; a key without a cursor begins at its first row.
    """
    after = log.join(cursors.select(F.col(key).alias("__key"), "last"), F.col(key).eqNullSafe(F.col("__key")), "left").where(
        "last IS NULL OR struct(ts, event_id) > last").drop("__key", "last")
    return after.withColumn("__n", F.expr(f"row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id)")).where(F.col("__n") <= size).drop("__n")


def advanced(batch: DataFrame, cursors: DataFrame, key: str = "pid") -> DataFrame:
    """The cursors after a batch."""
    return batch.select(key, F.struct("ts", "event_id").alias("last")).unionByName(cursors.select(key, "last")).groupBy(key).agg(F.max("last").alias("last"))


def no_cursors(log: DataFrame, key: str = "pid") -> DataFrame:
    return log.select(key, F.struct("ts", "event_id").alias("last")).where("false")


def last_before(log: DataFrame, key: str, value: str, name: str, slice_: str = "date(ts)") -> DataFrame:
    """Adds the greatest value of a key's rows before each row, by time; ``slice_`` cuts the time, so that a hot key is many tasks."""
    cut = log.selectExpr("*", f"{slice_} AS __slice", f"{value} AS __value")
    parts = cut.groupBy(key, "__slice").agg(F.max("__value").alias("__most")).selectExpr(
        f"{key} AS __key", "__slice AS __of", f"max(__most) OVER (PARTITION BY {key} ORDER BY __slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS __before")
    own = cut.selectExpr("*", f"max(__value) OVER (PARTITION BY {key}, __slice ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS __own")
    same = F.col(key).eqNullSafe(F.col("__key")) & F.col("__slice").eqNullSafe(F.col("__of"))
    return own.join(parts, same).withColumn(name, F.greatest("__own", "__before")).select(*log.columns, name)


def last_access(log: DataFrame) -> DataFrame:
    return log.groupBy(*KEY).agg(F.max("ts").alias("last_ts"), F.count("*").alias("accesses"))


def cold_pages(log: DataFrame, now: str, idle_days: int) -> DataFrame:
    """Pages without an access for so many days before ``now``."""
    return last_access(log).where(f"last_ts < timestamp_ntz '{now}' - make_dt_interval({idle_days})")


def sweeps(log: DataFrame, start: str, days: int) -> DataFrame:
    """Mark and sweep by epochs of whole days: (epoch, pages swept).

    A page that was accessed in one epoch is marked at its end, and swept at the
    end of the next unless it was accessed in between.
    """
    epoch = F.expr(f"datediff(ts, date '{start}') div {days}")
    touched = log.select(*KEY, epoch.alias("epoch")).distinct()
    after = touched.selectExpr(*KEY, "epoch", "lead(epoch) OVER (PARTITION BY owner_id, page_index ORDER BY epoch) AS next")
    return after.where("next IS NULL OR next > epoch + 1").groupBy((F.col("epoch") + 1).cast("bigint").alias("epoch")).agg(F.count("*").alias("swept"))


def not_skipped(pages: DataFrame, failed: DataFrame) -> DataFrame:
    """Without pages whose slot of the skip list a failed page has set."""
    slot = (F.col("page_index") * 31 + F.col("owner_id")) % SKIP_SLOTS
    slots = failed.select(slot.alias("slot")).distinct()
    return pages.withColumn("slot", slot).join(slots, "slot", "left_anti").drop("slot")


def adaptive_interval(cycles: DataFrame, base: int = 1000) -> DataFrame:
    """The interval after each scan cycle and whether the skip list decays there.

    k empty cycles in a row give base + 2000 k, up to 30 s. ``cycles`` is a
    scanner's own log of (scanner, cycle, result).
    """
    runs = cycles.selectExpr("*", "sum(IF(result > 0, 1, 0)) OVER (PARTITION BY scanner ORDER BY cycle) AS island")
    counted = runs.selectExpr("*", "sum(IF(result > 0, 0, 1)) OVER (PARTITION BY scanner, island ORDER BY cycle) AS k")
    return counted.selectExpr(
        "scanner", "cycle", "result", "k AS empty_cycles", f"CAST(IF(k = 0, {base}, least({base} + {INTERVAL_STEP_MS} * k, {INTERVAL_MOST_MS})) AS BIGINT) AS interval_ms",
        f"k > 0 AND k % {DECAY_EPOCH} = 0 AS decays")


def tiers(log: DataFrame, now: str) -> DataFrame:
    """Pages by tier of their idle days."""
    idle = F.expr(f"datediff(date '{now}', last_ts)")
    return last_access(log).withColumn("tier", scalar.tier(idle)).groupBy("tier").agg(F.count("*").alias("pages"), F.sum("accesses").alias("accesses"))


def tier_transitions(log: DataFrame) -> DataFrame:
    """How often a page was found in a tier when it was accessed again."""
    gaps = log.selectExpr("owner_id", "ts", "lag(ts) OVER (PARTITION BY owner_id ORDER BY ts) AS before").where("before IS NOT NULL")
    return gaps.groupBy(scalar.tier(F.expr("datediff(ts, before)")).alias("tier")).agg(F.count("*").alias("n"))


def buffers(embeddings: DataFrame) -> DataFrame:
    """Device buffers from a rule over vectors: format, size, coded size, idle time."""
    return embeddings.selectExpr(
        "vec_id AS buf_id", "4096 * (1 + vec_id % 8) AS size", "int(vec_id % 6) AS weight_format", "vec_id % 5 <> 0 AS compressed",
        "4096 * (1 + vec_id % 8) div (1 + vec_id % 4) AS compressed_size", "bigint(vec_id * 7 % 101) AS idle")


def buffer_stats(bufs: DataFrame) -> DataFrame:
    """Totals of buffers, coded buffers, bytes and saved bytes."""
    packed = F.col("compressed")
    return bufs.agg(
        F.count("*").alias("buffers"), F.sum("size").alias("total_bytes"), F.count_if(packed).alias("compressed_buffers"),
        F.sum(F.when(packed, F.col("compressed_size"))).alias("compressed_bytes"),
        F.sum(F.when(packed, F.col("size") - F.col("compressed_size"))).alias("saved_bytes"))
