"""Page statistics and encoded sizes, for whole Arrow batches of pages at once.

A batch of binary pages is one contiguous buffer, seen as a (pages, 4096) array
without a copy; every function below handles all its pages in a few NumPy calls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .constants import DENSE, LINE, PAGE, RANGE_BITS, SIZED, SMALL_RANGE, SPARSE, SPARSE_MOST, UNIFORM, ZERO

#: Bits that hold 0..r, for each byte range r.
BITS = np.array([int(r).bit_length() for r in range(256)])


def pages_of(column: pa.Array) -> np.ndarray:
    """The batch's pages as rows; every value must be a whole page."""
    if not len(column):
        return np.zeros((0, PAGE), np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data.reshape(-1, PAGE)


def profile(p: np.ndarray) -> dict[str, np.ndarray]:
    n = len(p)
    histogram = np.bincount((np.arange(n)[:, None] * 256 + p).ravel(), minlength=n * 256).reshape(n, 256)
    there = histogram > 0
    steps = p[:, 1:].astype(np.int16) - p[:, :-1]
    zero = histogram[:, 0]
    return {
        "total_bytes": np.full(n, PAGE), "zero_bytes": zero, "zero_byte_frac_x256": zero * 256 // PAGE,
        "most_common_byte": histogram.argmax(1), "most_common_count": histogram.max(1),
        "upper32_zero_count": (p.view("<u4")[:, 1::2] == 0).sum(1),
        "small_value_count": histogram[:, :16].sum(1) + histogram[:, 240:].sum(1),
        "small_delta_count": ((steps >= -16) & (steps <= 15)).sum(1),
        "max_byte": 255 - there[:, ::-1].argmax(1), "min_byte": there.argmax(1),
    }


def block_shapes(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Type and payload of blocks along the last axis."""
    length = blocks.shape[-1]
    nonzero = (blocks != 0).sum(-1)
    spread = blocks.max(-1).astype(np.int64) - blocks.min(-1)
    bits = BITS[spread]
    kinds = np.select([nonzero == 0, spread == 0, nonzero <= SPARSE_MOST, bits <= RANGE_BITS], [ZERO, UNIFORM, SPARSE, SMALL_RANGE], DENSE)
    payload = np.select([kinds == ZERO, kinds == UNIFORM, kinds == SPARSE, kinds == SMALL_RANGE],
                        [0, 1, length // 8 + nonzero, 2 + (length * bits + 7) // 8], length)
    return kinds, payload


def lines(p: np.ndarray) -> np.ndarray:
    return p.reshape(len(p), -1, LINE)


def row_deltas(p: np.ndarray) -> np.ndarray:
    """Each line xor the line before; the first as it is."""
    out = lines(p).copy()
    out[:, 1:] ^= lines(p)[:, :-1]
    return out


def bdi_kinds(p: np.ndarray, strict: bool = True) -> np.ndarray:
    """1 zeros, 2 one word, 3 small deltas, 0 raw. Strict deltas fit a signed byte; else their size is below 256."""
    words = lines(p).view("<u8")
    base = words[..., :1]
    up, down = words - base, base - words
    most_up, most_down = (127, 128) if strict else (255, 255)
    close = np.where(words >= base, up <= most_up, down <= most_down).all(-1)
    return np.select([(words == 0).all(-1), (words == base).all(-1), close], [1, 2, 3], 0)


def size_bdi(p: np.ndarray, strict: bool = True) -> np.ndarray:
    return 4 + np.array([1 + LINE, 1, 9, 17])[bdi_kinds(p, strict)].sum(1)


def dictionary_tags(words: np.ndarray, slots: np.ndarray, n_slots: int, half: int) -> np.ndarray:
    """0 zero, 1 equal to the last nonzero word of its slot, 2 upper half zero, 3 other."""
    page, at = np.nonzero(words)
    value = words[page, at]
    key = page * n_slots + slots[page, at].astype(np.int64)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(order), bool)
    again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (value[order[1:]] == value[order[:-1]])
    tags = np.zeros(words.shape, np.uint8)
    tags[page, at] = np.where(again, 1, np.where(value >> value.dtype.type(half) == 0, 2, 3))
    return tags


def tags32(p: np.ndarray) -> np.ndarray:
    w = p.view("<u4")
    return dictionary_tags(w, w >> np.uint32(4) & np.uint32(15), 16, 16)


def tags64(p: np.ndarray) -> np.ndarray:
    w = p.view("<u8")
    return dictionary_tags(w, w >> np.uint64(3) & np.uint64(31), 32, 32)


def size_lz4(p: np.ndarray) -> np.ndarray:
    codec = pa.Codec("lz4_raw")
    return np.array([len(codec.compress(page, asbytes=True)) for page in map(bytes, p)])


def size_zstd(p: np.ndarray) -> np.ndarray:
    import zstandard

    coder = zstandard.ZstdCompressor(level=1, write_checksum=False)
    return np.array([len(coder.compress(page)) for page in map(bytes, p)])


def size_split(p: np.ndarray) -> np.ndarray:
    return 100 + block_shapes(np.stack([p[:, 0::2], p[:, 1::2]], 1).reshape(len(p), -1, LINE // 2))[1].sum(1)


SIZES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "same_page": lambda p: np.where((p == p[:, :1]).all(1), 5, PAGE),
    "same_page_kernel": lambda p: np.where((p == p[:, :1]).all(1), 1, PAGE),
    "bdi": size_bdi,
    "bdi_ref": lambda p: size_bdi(p, strict=False),
    "wkdm32": lambda p: 12 + 256 + np.array([0, 1, 2, 4])[tags32(p)].sum(1),
    "wkdm64": lambda p: 12 + 128 + np.array([0, 1, 4, 8])[tags64(p)].sum(1),
    "block_class": lambda p: 28 + block_shapes(lines(p))[1].sum(1),
    "lz4": size_lz4,
    "zstd": size_zstd,
    "ai_fp16": size_split,
    "ai_bf16": size_split,
    "ai_int8": lambda p: 28 + block_shapes(row_deltas(p))[1].sum(1),
}


def encoded_size(p: np.ndarray, codec: str) -> np.ma.MaskedArray:
    """Bytes, masked where the codec doesn't shrink the page."""
    size = SIZES[codec](p) if len(p) else np.zeros(0, np.int64)
    return np.ma.masked_array(size, size >= PAGE)


def block_profile(p: np.ndarray) -> dict[str, np.ndarray]:
    kinds, payload = block_shapes(lines(p))
    names = ("n_zero", "n_sparse", "n_uniform", "n_small_range", "n_dense")
    return {name: (kinds == k).sum(1) for k, name in enumerate(names)} | {"payload_bytes": payload.sum(1)}


def with_features(pages: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Replaces ``page`` by features: ``profile``, ``blocks`` or ``size_<codec>`` for any codec of SIZES."""
    keys = [f for f in pages.schema.fields if f.name != "page"]
    at = pages.columns.index("page")

    def compute(p: np.ndarray) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for w in wanted:
            out |= profile(p) if w == "profile" else block_profile(p) if w == "blocks" else {w: encoded_size(p, w.removeprefix("size_"))}
        return out

    names = list(compute(np.zeros((1, PAGE), np.uint8)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = compute(pages_of(batch.column(at)))
                columns = [c for k, c in enumerate(batch.columns) if k != at]
                values = [pa.array(np.ma.getdata(v).astype(np.int64), mask=np.ma.getmaskarray(v)) for v in found.values()]
                yield pa.RecordBatch.from_arrays([*columns, *values], [*(f.name for f in keys), *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in keys] + [f"`{n}` bigint" for n in names]
    return pages.mapInArrow(run, ", ".join(fields))


def xor_counts(pairs: DataFrame) -> DataFrame:
    """Replaces ``page`` and ``base`` by the number of bytes that differ and the sum of their xor."""
    keys = [f for f in pairs.schema.fields if f.name not in ("page", "base")]
    at, base = (pairs.columns.index(c) for c in ("page", "base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pages_of(batch.column(at)) ^ pages_of(batch.column(base))
            yield pa.RecordBatch.from_arrays(
                [*batch.select([f.name for f in keys]).columns, pa.array((x != 0).sum(1).astype(np.int64)), pa.array(x.sum(1, dtype=np.int64))],
                [*(f.name for f in keys), "changed", "xor_sum"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)
    return pairs.mapInArrow(run, f"{fields}, changed bigint, xor_sum bigint")


def byte_counts(pages: DataFrame) -> DataFrame:
    """(byte, n) over all pages: at most 256 rows leave a batch."""
    at = pages.columns.index("page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.bincount(pages_of(batch.column(at)).ravel(), minlength=256)
            there = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(counts[there])], ["byte", "n"])

    return pages.mapInArrow(run, "byte int, n bigint").groupBy("byte").agg(F.sum("n").alias("n"))


def with_sizes(pages: DataFrame, codecs: Sequence[str] = SIZED) -> DataFrame:
    return with_features(pages, [f"size_{c}" for c in codecs])
