"""Numbers, names and thresholds of the page model."""

PAGE = 4096
LINE = 64
LINES = PAGE // LINE

#: Codec ids by name.
CODECS = {
    "same_page": 0, "bdi": 1, "wkdm32": 2, "lz4": 3, "lzsse8": 4, "zstd": 5,
    "delta": 6, "wkdm64": 7, "block_class": 8, "ai_fp16": 9, "ai_bf16": 10, "ai_int8": 11,
}
CODEC_NAMES = {v: k for k, v in CODECS.items()}
#: Codecs whose exact size is a formula, in the order that breaks ties.
SIZED = ("same_page", "bdi", "wkdm32", "wkdm64", "block_class", "ai_fp16", "ai_int8")
#: All codecs that the reference compares, in its order, which breaks ties.
COMPARED = ("same_page", "bdi", "wkdm32", "wkdm64", "block_class", "lz4", "zstd", "ai_fp16", "ai_bf16", "ai_int8")

#: Block types.
ZERO, SPARSE, UNIFORM, SMALL_RANGE, DENSE = range(5)
BLOCK_TYPES = {ZERO: "zero", SPARSE: "sparse", UNIFORM: "uniform", SMALL_RANGE: "small_range", DENSE: "dense"}
SPARSE_MOST, RANGE_BITS = 16, 6

#: Page types with names and what they stand for.
PAGE_TYPES = {
    0: ("random", "bytes without structure"), 1: ("zero", "all zero"), 2: ("repeat_val", "one 8-byte value again and again"),
    3: ("pointer_heavy", "kernel-like pointers and small words"), 4: ("integer_heavy", "words of few significant bytes"),
    5: ("pte", "page-table entries"), 6: ("ai_fp16", "half-precision weights in clusters"), 7: ("ai_int8", "rows of correlated int8 weights"),
    8: ("ai_sparse", "a third of the lines zero"), 9: ("delta_pair", "a page and its edited copy"), 10: ("mixed", "half random, half pointers"),
}

MIN_SAVINGS_PCT, MIN_SAVINGS_RANGE = 13, (0, 90)
TOP_N, TOP_N_RANGE = 5, (1, 20)
INTERVAL_RANGE_MS = (100, 60_000)
CPU_BUDGET_RANGE, MARK_BUDGET_RANGE = (1, 1000), (4096, 524_288)
MOST_PIDS = 1024
CLUSTER = 32
SKIP_SLOTS = 1 << 14
#: Pages that a scan takes at once, when it sweeps, marks and falls back to frame numbers.
SWEEP_BATCH, MARK_BATCH, PFN_BATCH = 8192, 65_536, 256
INTERVAL_STEP_MS, INTERVAL_MOST_MS, DECAY_EPOCH = 2000, 30_000, 8

#: Tiers with the idle time above which they begin.
TIERS = (("HOT", None), ("WARM", 4), ("COLD", 16), ("FROZEN", 64))
FORMATS = {0: "FP32", 1: "FP16", 2: "BF16", 3: "INT8", 4: "INT4"}


def clamp(value: int, bounds: tuple[int, int]) -> int:
    """Intervals, budgets and savings outside their range are moved to its edge."""
    return min(max(value, bounds[0]), bounds[1])


def checked_top_n(n: int) -> int:
    """A number of top rows outside its range is refused."""
    if not TOP_N_RANGE[0] <= n <= TOP_N_RANGE[1]:
        raise ValueError(f"top_n must lie in {TOP_N_RANGE}")
    return n
