"""Device buffers from their events: register, compress, decompress, touch, unregister.

A buffer is absent, hot or warm. An event changes that only where it fits: a
hot buffer whose code is shorter is compressed, a warm one decompressed; what
doesn't fit is left out. Unregistering keeps the counters, as compressed and saved
bytes are never taken back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGISTER, UNREGISTER, COMPRESS, DECOMPRESS, TOUCH = range(1, 6)
STATES = ("ABSENT", "HOT", "WARM")
COUNTS = ("registers", "unregisters", "compresses", "decompresses")


def buffer_events(events: DataFrame) -> DataFrame:
    """(buf_id, ts, event_id, op, size, compressed_size) of an events table; sizes go by a rule."""
    return events.selectExpr(
        "user_id AS buf_id", "ts", "event_id",
        f"CASE event_type WHEN 'signup' THEN {REGISTER} WHEN 'error' THEN {UNREGISTER} WHEN 'purchase' THEN {COMPRESS} WHEN 'click' THEN {DECOMPRESS} ELSE {TOUCH} END AS op",
        "4096 * (1 + user_id % 8) AS size", "4096 * (1 + user_id % 8) div (1 + user_id % 4) AS compressed_size")


#: A state s after an operation x: what each operation does where it fits.
_STEP = f"""named_struct(
    'st', CASE WHEN x.op = {REGISTER} AND s.st = 0 THEN 1 WHEN x.op = {UNREGISTER} THEN 0 WHEN x.op = {COMPRESS} AND s.st = 1 AND x.fits THEN 2
               WHEN x.op = {DECOMPRESS} AND s.st = 2 THEN 1 ELSE s.st END,
    'registers', s.registers + IF(x.op = {REGISTER} AND s.st = 0, 1L, 0L), 'unregisters', s.unregisters + IF(x.op = {UNREGISTER} AND s.st > 0, 1L, 0L),
    'compresses', s.compresses + IF(x.op = {COMPRESS} AND s.st = 1 AND x.fits, 1L, 0L), 'decompresses', s.decompresses + IF(x.op = {DECOMPRESS} AND s.st = 2, 1L, 0L),
    'last', CASE WHEN (x.op = {REGISTER} AND s.st = 0) OR (x.op = {DECOMPRESS} AND s.st = 2) OR (x.op = {TOUCH} AND s.st > 0) THEN x.ts
                 WHEN x.op = {UNREGISTER} THEN NULL ELSE s.last END,
    'gone', s.gone OR x.op = {UNREGISTER})"""


def life_cycle(events: DataFrame, slice_: str = "date(ts)") -> DataFrame:
    """(buf_id, state, registers, unregisters, compresses, decompresses, last_access, size, compressed_size) of every buffer with events.

    A part of a buffer's events is a function from the state before it to the state
    after, so parts (``slice_`` of the time) are folded on their own from each of the
    three states, and a buffer's parts are chained; a buffer with very many events is many tasks.
    """
    nothing = "named_struct('st', {0}, 'registers', 0L, 'unregisters', 0L, 'compresses', 0L, 'decompresses', 0L, 'last', CAST(NULL AS timestamp_ntz), 'gone', false)"
    starts = "array(" + ", ".join(nothing.format(k) for k in range(3)) + ")"
    parts = events.withColumn("part", F.expr(slice_)).groupBy("buf_id", "part").agg(
        F.max("size").alias("size"), F.max("compressed_size").alias("compressed_size"),
        F.array_sort(F.collect_list(F.expr("struct(ts, event_id, op, compressed_size < size AS fits)"))).alias("ops"))
    folded = parts.select("buf_id", "part", "size", "compressed_size", F.expr(f"aggregate(ops, {starts}, (acc, x) -> transform(acc, s -> {_STEP}))").alias("after"))
    chained = folded.groupBy("buf_id").agg(
        F.max("size").alias("size"), F.max("compressed_size").alias("compressed_size"), F.array_sort(F.collect_list(F.struct("part", "after"))).alias("parts"))
    sums = ", ".join(f"'{c}', s.{c} + x.after[s.st].{c}" for c in COUNTS)
    end = F.expr(f"""aggregate(parts, {nothing.format(0)}, (s, x) -> named_struct('st', x.after[s.st].st, {sums},
        'last', coalesce(x.after[s.st].last, IF(x.after[s.st].gone, NULL, s.last)), 'gone', false))""")
    names = F.array(*map(F.lit, STATES))
    return chained.select("buf_id", "size", "compressed_size", end.alias("e")).select(
        "buf_id", F.get(names, F.col("e.st")).alias("state"), *(F.col(f"e.{c}") for c in COUNTS), F.col("e.last").alias("last_access"), "size", "compressed_size")


def ledger(buffers: DataFrame) -> DataFrame:
    """One row of totals: buffers and bytes that are registered, and what was ever compressed and saved."""
    there = F.col("state") != "ABSENT"
    return buffers.agg(
        F.count_if(there).alias("n_bufs"), F.coalesce(F.sum(F.when(there, F.col("size"))), F.lit(0)).alias("total_vram_bytes"),
        F.sum(F.col("compresses") * F.col("compressed_size")).alias("total_compressed_bytes"), F.sum(F.col("compresses") * (F.col("size") - F.col("compressed_size"))).alias("total_saved_bytes"),
        F.sum("compresses").alias("compress_count"), F.sum("decompresses").alias("decompress_count"))


def lookup(pointers: DataFrame, buffers: DataFrame) -> DataFrame:
    """pointers (buf_id and more) with the state and size of the buffer, or nulls where none is registered."""
    return pointers.join(buffers.where("state <> 'ABSENT'").select("buf_id", "state", "size"), "buf_id", "left")


def idle_sweep(buffers: DataFrame, before: str) -> DataFrame:
    """The hot buffers without an access since, that a sweep would compress."""
    return buffers.where(f"state = 'HOT' AND last_access < timestamp_ntz '{before}' AND compressed_size < size")
