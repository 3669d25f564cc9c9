"""Synthetic pages of eleven types from a seed, for tests and benchmarks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.constants import PAGE, PAGE_TYPES

WORDS = PAGE // 8
#: The generator's increment and multipliers.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MASK = (1 << 64) - 1
POINTER, FRAME, FLAGS = 0xFFFF800000000000, 0x100000, 0x8000000000000063


def draws(seed: int, count: int) -> np.ndarray:
    """The first numbers of a seed's stream; the state advances evenly, so all are made at once."""
    z = np.uint64(seed & MASK) + np.uint64(STEP) * np.arange(1, count + 1, dtype=np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND)
    return z ^ (z >> np.uint64(31))


class Stream:
    """Draws one by one, for types whose use of them depends on their values."""

    def __init__(self, seed: int, most: int) -> None:
        self.left = iter(draws(seed, most).tolist())

    def __call__(self) -> int:
        return next(self.left)


def random_bytes(seed: int, size: int = PAGE) -> bytes:
    return draws(seed, -(-size // 8)).tobytes()[:size]


def pointers(seed: int, size: int = PAGE) -> bytes:
    r, out = Stream(seed, size // 4), []
    for _ in range(size // 8):
        x = r()
        out.append((0, None, None, POINTER + (x >> 8 & 0xFFF))[x % 4] if x % 4 in (0, 3) else POINTER + (r() & 0x0FFFFFFF) if x % 4 == 1 else r() & 0xFFFFFF)
    return np.array(out, "<u8").tobytes()


def integers(seed: int) -> bytes:
    r, out = Stream(seed, 2 * WORDS), []
    for _ in range(WORDS):
        kind = r() % 5
        out.append(0 if kind == 0 else r() >> 16 & 0xFF if kind == 4 else r() & (1 << 8 * (1, 2, 4)[kind - 1]) - 1)
    return np.array(out, "<u8").tobytes()


def table_entries(seed: int) -> bytes:
    r, out = Stream(seed, 2 * WORDS), []
    for i in range(WORDS):
        x = r()
        if x % 10 == 0:
            out.append(0)
            continue
        entry = FRAME + i + r() % 4 << 12 | FLAGS & ~0xFFFFF000
        out.append(entry & ~(1 << 5) if x % 3 == 0 else entry)
    return np.array(out, "<u8").tobytes()


def half_floats(values: np.ndarray) -> np.ndarray:
    """float32 to half precision, truncated instead of rounded, as the reference numbers need."""
    bits = values.astype(np.float32).view(np.uint32).astype(np.int64)
    sign, exponent, mantissa = bits >> 16 & 0x8000, (bits >> 23 & 0xFF) - 127, bits & 0x7FFFFF
    normal = sign | (exponent + 15 << 10) | mantissa >> 13
    small = sign | np.where(exponent > -25, (mantissa | 0x800000) >> np.clip(-4 - exponent, 0, 40), 0)
    return np.select([values == 0, exponent > 15, exponent >= -14], [sign, sign | 0x7C00, normal], small).astype("<u2")


def half_weights(seed: int) -> bytes:
    r, out = Stream(seed, 4 * PAGE), []
    for _ in range(PAGE // 64):
        x = r()
        if x % 8 == 0:
            out.append(np.zeros(32, np.float32))
        elif x % 4 == 0:
            out.append(np.full(32, (r() % 7 - 3) * 0.125, np.float32))
        else:
            base = np.float32((0.00390625, 0.0625, 1.0, 16.0, 256.0)[r() % 5])
            base = -base if r() % 5 == 0 else base
            noise = np.array([(r() & 0xF) - 8 for _ in range(32)], np.float32)
            out.append(base + noise * (base * np.float32(0.001)))
    return half_floats(np.concatenate(out)).tobytes()


def byte_weights(seed: int) -> bytes:
    r, before, out = Stream(seed, 2 * PAGE), [0] * 64, []
    for row in range(PAGE // 64):
        base = (r() >> 4 & 0x3F) - 32
        now = []
        for column in range(64):
            x = r()
            now.append((base + (x >> 8 & 0x1F) - 16 if row == 0 or x % 3 == 0 else before[column] + (x >> 8 & 7) - 4) & 0xFF)
        before = now
        out.append(bytes(now))
    return b"".join(out)


def sparse_lines(seed: int) -> bytes:
    r = Stream(seed, PAGE)
    return b"".join(bytes(64) if r() % 3 == 0 else random_bytes(r(), 64) for _ in range(PAGE // 64))


def edited(seed: int) -> tuple[bytes, bytes]:
    """A random page with some bytes changed, and the page before."""
    base, r = random_bytes(seed), Stream(seed + 1, PAGE)
    out = bytearray(base)
    for _ in range(PAGE // 80):
        at = r() % PAGE
        out[at] = r() & 0xFF
    return bytes(out), base


def mixed_halves(seed: int) -> bytes:
    return random_bytes(seed, PAGE // 2) + pointers(int(draws(seed, 1)[0]), PAGE // 2)


def page(kind: int, seed: int) -> tuple[bytes, bytes | None]:
    """(data, base) of a page type; only an edited pair has a base."""
    made = (random_bytes, lambda s: bytes(PAGE), lambda s: np.full(WORDS, 0xDEADBEEFCAFEBABE, "<u8").tobytes(), pointers, integers,
            table_entries, half_weights, byte_weights, sparse_lines, edited, mixed_halves)[kind](seed)
    return made if isinstance(made, tuple) else (made, None)


def synthetic_pages(spark: SparkSession, per_type: int = 1, seed: int = 42) -> DataFrame:
    """All types; the first page of a type has the seed plus the type's number."""

    def make(batches):
        for rows in batches:
            found = [page(int(n) % len(PAGE_TYPES), seed + int(n)) for n in rows["id"]]
            kinds = rows["id"] % len(PAGE_TYPES)
            yield pd.DataFrame({
                "page_type": kinds.astype("int32"), "name": [PAGE_TYPES[k][0] for k in kinds], "description": [PAGE_TYPES[k][1] for k in kinds],
                "seed": seed + rows["id"], "page": [p for p, _ in found], "delta_base": [b for _, b in found]})

    return spark.range(per_type * len(PAGE_TYPES)).mapInPandas(
        make, "page_type int, name string, description string, seed bigint, page binary, delta_base binary")
