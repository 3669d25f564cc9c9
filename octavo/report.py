"""A report of the statistics as text: status, configuration, processes, owners, watching."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame

from . import __version__
from .functions.constants import CPU_BUDGET_RANGE, INTERVAL_RANGE_MS, MARK_BUDGET_RANGE, MIN_SAVINGS_PCT, MIN_SAVINGS_RANGE, TOP_N, checked_top_n, clamp
from .streaming import live

#: What can be set: the value to begin with, and the range that other values are moved into.
SETTINGS = {
    "scanner_enabled": (1, (0, 1)), "scanner_interval_ms": (1000, INTERVAL_RANGE_MS), "min_savings_pct": (MIN_SAVINGS_PCT, MIN_SAVINGS_RANGE),
    "scanner_cpu_budget_ms": (100, CPU_BUDGET_RANGE), "scanner_mark_budget_pages": (65_536, MARK_BUDGET_RANGE), "max_pool_pages": (0, (0, 1 << 62)), "parallel_mode": (2, (0, 2)),
    "per_process_stats": (1, (0, 1)), "per_process_top_n": (TOP_N, None),
}


def parallel_active(mode: int, cpus: int) -> bool:
    """Mode 0 is off, 1 on, 2 on with two CPUs or more."""
    return mode == 1 or (mode == 2 and cpus >= 2)


def human_bytes(n: int) -> str:
    """With a unit and one decimal, cut off."""
    for unit, size in (("G", 1 << 30), ("M", 1 << 20), ("K", 1 << 10)):
        if n >= size:
            return f"{n * 10 // size // 10}.{n * 10 // size % 10}{unit}"
    return f"{n}B"


class Config:
    """Settings; a number outside a range is moved to its edge, and a number of top rows outside its own is refused."""

    def __init__(self) -> None:
        self.values = {k: v for k, (v, _) in SETTINGS.items()}

    def set(self, key: str, value: int) -> int:
        if key not in SETTINGS:
            raise KeyError(key)
        bounds = SETTINGS[key][1]
        self.values[key] = checked_top_n(value) if bounds is None else clamp(value, bounds)
        return self.values[key]

    def lines(self) -> list[str]:
        return [f"{k:<28}{v}" for k, v in self.values.items()]


def status(views: DataFrame) -> list[str]:
    """The row of ``stats.stat_views``, a line for each statistic."""
    row = views.first().asDict()
    return [f"{k:<28}{human_bytes(v) if k.endswith(('bytes_saved', '_bytes', '_saved')) and v >= 0 else v}" for k, v in row.items()]


def table(rows: DataFrame, most: int = 20) -> list[str]:
    """A header and the first rows, such as of processes or owners."""
    found = rows.limit(most).collect()
    return ["\t".join(rows.columns), *("\t".join("" if v is None else str(v) for v in r) for r in found)]


def watch(views: Callable[[], DataFrame], show: Callable[[str], None] = print, every: float = 2.0, stop: threading.Event | None = None) -> int:
    return live.dashboard(lambda: status(views()), show, every, stop)


def version() -> str:
    return f"octavo {__version__}"
