"""Structured Streaming: process counters, idle pages, sessions, device buffers and a page store over an unbounded log."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.constants import DECAY_EPOCH, INTERVAL_MOST_MS, INTERVAL_STEP_MS
from ..operators import stats, vram


def timed(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The log with an event time that a watermark takes; ``ts`` may come without a zone."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def pid_stats(events: DataFrame) -> DataFrame:
    """The running counters of each process, for the complete or update mode."""
    return stats.per_pid(stats.process_events(events))


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Closed sessions, for the append mode; those open at the end aren't given."""
    return timed(events).groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select(
        "user_id", F.col("w.start").alias("start_ts"), "n")


class IdlePages(StatefulProcessor):
    """A page's last access; an event-time timer gives it as cold when it stays idle long enough."""

    def __init__(self, idle: timedelta) -> None:
        self.idle_ms = int(idle.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_ms bigint, accesses bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, n = self.last.get() if self.last.exists() else (0, 0)
        for part in rows:
            last = max(last, int(part["at_ms"].max()))
            n += len(part)
        self.last.update((last, n))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + self.idle_ms)
        yield pd.DataFrame({"owner_id": [], "page_index": [], "last_ms": [], "accesses": []}).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, n = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"owner_id": [key[0]], "page_index": [key[1]], "last_ms": [last], "accesses": [n]})

    def close(self) -> None:
        pass


def cold_pages(events: DataFrame, idle: timedelta = timedelta(days=7)) -> DataFrame:
    """Pages as they become cold. Needs the RocksDB state store."""
    log = timed(events).select("at", F.col("user_id").alias("owner_id"), (F.col("event_id") % 64).alias("page_index"),
                               F.unix_millis("at").alias("at_ms"))
    return log.groupBy("owner_id", "page_index").transformWithStateInPandas(
        IdlePages(idle), "owner_id bigint, page_index bigint, last_ms bigint, accesses bigint", "append", "eventtime")


class PidCounters(StatefulProcessor):
    """A process's counters; those of a process without an event for so long are given and forgotten."""

    def __init__(self, idle: timedelta) -> None:
        self.idle_ms = int(idle.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "last_ms bigint, packed bigint, opened bigint, saved bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, packed, opened, saved = self.now.get() if self.now.exists() else (0, 0, 0, 0)
        for part in rows:
            own = part["op"] == "compress"
            last = max(last, int(part["at_ms"].max()))
            packed, opened, saved = packed + int(own.sum()), opened + int((~own).sum()), saved + int(part["bytes_saved"][own].sum())
        self.now.update((last, packed, opened, saved))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + self.idle_ms)
        yield pd.DataFrame({"pid": [], "last_ms": [], "pages_compressed": [], "pages_decompressed": [], "bytes_saved": []}).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, packed, opened, saved = self.now.get()
        self.now.clear()
        yield pd.DataFrame({"pid": [key[0]], "last_ms": [last], "pages_compressed": [packed], "pages_decompressed": [opened], "bytes_saved": [saved]})

    def close(self) -> None:
        pass


def ended_pids(events: DataFrame, idle: timedelta = timedelta(days=2)) -> DataFrame:
    """The counters of processes that have ended, as they are forgotten. Needs the RocksDB state store."""
    ops = stats.process_events(events).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    return ops.select("at", "pid", "op", "bytes_saved", F.unix_millis("at").alias("at_ms")).groupBy("pid").transformWithStateInPandas(
        PidCounters(idle), "pid bigint, last_ms bigint, pages_compressed bigint, pages_decompressed bigint, bytes_saved bigint", "append", "eventtime")


class Buffers(StatefulProcessor):
    """A device buffer's state and counters; each batch gives the buffers that it touched as they are then."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "st int, registers bigint, unregisters bigint, compresses bigint, decompresses bigint, last_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        st, reg, unreg, packed, opened, last = self.now.get() if self.now.exists() else (0, 0, 0, 0, 0, -1)
        for r in pd.concat(rows).sort_values(["at_us", "event_id"]).itertuples():
            if r.op == vram.REGISTER and st == 0:
                st, reg, last = 1, reg + 1, r.at_us
            elif r.op == vram.UNREGISTER and st:
                st, unreg, last = 0, unreg + 1, -1
            elif r.op == vram.COMPRESS and st == 1 and r.compressed_size < r.size:
                st, packed = 2, packed + 1
            elif r.op == vram.DECOMPRESS and st == 2:
                st, opened, last = 1, opened + 1, r.at_us
            elif r.op == vram.TOUCH and st:
                last = r.at_us
        self.now.update((st, reg, unreg, packed, opened, last))
        yield pd.DataFrame({"buf_id": [key[0]], "state": [vram.STATES[st]], "registers": [reg], "unregisters": [unreg], "compresses": [packed], "decompresses": [opened], "last_us": [last]})

    def close(self) -> None:
        pass


def buffers(events: DataFrame) -> DataFrame:
    """Device buffers as their events come, for the update mode; last_us is -1 where there was no access. Needs the RocksDB state store."""
    rows = vram.buffer_events(events).withColumn("at_us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")
    return rows.groupBy("buf_id").transformWithStateInPandas(
        Buffers(), "buf_id bigint, state string, registers bigint, unregisters bigint, compresses bigint, decompresses bigint, last_us bigint", "update", "none")


class PageStore(StatefulProcessor):
    """An owner's entries by page: put, remove, look up; beyond a bound on the pages the least are drained."""

    def __init__(self, most: int = 0) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "page_index bigint", "algo_id int, code binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(rows).sort_values("seq").itertuples():
            at = (int(r.page_index),)
            found = self.entries.getValue(at) if self.entries.containsKey(at) else None
            if r.op == "put":
                self.entries.updateValue(at, (int(r.algo_id), bytes(r.code)))
                if self.most:
                    pages = sorted(k[0] for k in self.entries.keys())
                    for page in pages[:max(0, len(pages) - self.most)]:
                        algo, code = self.entries.getValue((page,))
                        self.entries.removeKey((page,))
                        out.append((r.seq, "drain", page, algo, bytes(code)))
            elif r.op == "fault":
                out.append((r.seq, "hit", at[0], found[0], bytes(found[1])) if found else (r.seq, "miss", at[0], None, None))
            elif r.op == "remove" and found:
                self.entries.removeKey(at)
                out.append((r.seq, "removed", at[0], found[0], bytes(found[1])))
        seq, what, page, algo, code = map(list, zip(*out)) if out else ([], [], [], [], [])
        yield pd.DataFrame({"owner_id": [key[0]] * len(out), "seq": seq, "what": what, "page_index": page, "algo_id": pd.array(algo, "Int32"), "code": code})

    def close(self) -> None:
        pass


def page_store(ops: DataFrame, most: int = 0) -> DataFrame:
    """What the operations (owner_id, seq, op, page_index, algo_id, code) of a store give: hits with their codes, misses, removed and drained entries.

    A hit's code is read by ``codes.restored``. The state is one owner's map, whose entries are keyed on their own.
    """
    return ops.groupBy("owner_id").transformWithStateInPandas(
        PageStore(most), "owner_id bigint, seq bigint, what string, page_index bigint, algo_id int, code binary", "append", "none")


def scan_loop(cycle: Callable[[], int], wait: Callable[[float], bool], base_ms: int = 1000) -> list[tuple[int, int, bool]]:
    """Runs scan cycles until ``wait`` (seconds; such as an event's) says so: (result, interval, skip list decays) of each.

    A cycle is one run over what has come, such as a query with availableNow; it gives
    the number of pages that it coded. After k empty cycles in a row the next waits longer.
    """
    empty, out = 0, []
    while True:
        result = cycle()
        empty = 0 if result > 0 else empty + 1
        interval = base_ms if not empty else min(base_ms + INTERVAL_STEP_MS * empty, INTERVAL_MOST_MS)
        out.append((result, interval, empty > 0 and empty % DECAY_EPOCH == 0))
        if wait(interval / 1000):
            return out


def dashboard(lines: Callable[[], list[str]], show: Callable[[str], None] = print, every: float = 2.0, stop: threading.Event | None = None) -> int:
    """Shows the lines again and again until stopped; gives how often."""
    stop, n = stop or threading.Event(), 0
    while True:
        show("\n".join(lines()))
        n += 1
        if stop.wait(every):
            return n
