"""Codec bytes of tables of pages: coding, decoding, and round trips."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import batches as bytes_of
from ..functions import kernels
from ..functions.constants import CODEC_NAMES, CODECS, COMPARED, PAGE


def _fields(df: DataFrame, *left_out: str) -> list:
    return [f for f in df.schema.fields if f.name not in left_out]


def _ddl(fields: list) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow column over a flat array of bytes, without copies."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes and offsets."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def with_codes(pages: DataFrame, codecs: list[str]) -> DataFrame:
    """A row for each page and codec: its size (null where declined), and whether decoding gives the page back."""
    keys, at = _fields(pages, "page"), pages.columns.index("page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = kernels.pages_of(batch.column(at))
            for codec in codecs if len(p) else ():
                data, offsets = bytes_of.encoded(codec, p)
                there = bytes_of.shrinks(codec, p, offsets)
                own = np.flatnonzero(there)
                exact = np.zeros(len(p), bool)
                exact[own] = (bytes_of.decoded(codec, *bytes_of.taken(data, offsets, own)) == p[own]).all(1)
                made = [pa.array([codec] * len(p)), pa.array(np.diff(offsets), mask=~there), pa.array(exact, mask=~there)]
                yield pa.RecordBatch.from_arrays([*batch.select([f.name for f in keys]).columns, *made], [*(f.name for f in keys), "codec", "encoded_size", "exact"])

    return pages.mapInArrow(run, f"{_ddl(keys)}, codec string, encoded_size bigint, exact boolean")


def stored(pages: DataFrame, codecs=COMPARED, min_pct: int = 13) -> DataFrame:
    """The pages worth storing: the key columns, algo_id, compressed_len and the code by the codec with the least size, the first of a tie."""
    keys, at = _fields(pages, "page"), pages.columns.index("page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = kernels.pages_of(batch.column(at))
            if not len(p):
                continue
            sizes = np.stack([kernels.encoded_size(p, c).filled(PAGE) for c in codecs])
            best, least = sizes.argmin(0), sizes.min(0)
            worth = (least < PAGE) & (100 * (PAGE - least) // PAGE >= min_pct)
            for k in np.unique(best[worth]).tolist():
                own = np.flatnonzero(worth & (best == k))
                data, offsets = bytes_of.encoded(codecs[k], p[own])
                columns = batch.select([f.name for f in keys]).take(pa.array(own)).columns
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.full(len(own), CODECS[codecs[k]], np.int32)), pa.array(np.diff(offsets)), _binary(data, offsets)],
                    [*(f.name for f in keys), "algo_id", "compressed_len", "code"])

    return pages.mapInArrow(run, f"{_ddl(keys)}, algo_id int, compressed_len bigint, code binary")


#: Status of an entry that was found, that isn't stored, and whose code doesn't give a page.
FOUND, MISSING, BROKEN = 0, -2, -22


def restored(entries: DataFrame) -> DataFrame:
    """Replaces ``code`` by ``page`` and ``status``: entries without a code are missing, and a code that can't be decoded is broken."""
    keys = _fields(entries, "code")
    algo, code = entries.columns.index("algo_id"), entries.columns.index("code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = np.array(batch.column(code).is_valid())
            ids = batch.column(algo).fill_null(-1).to_numpy(zero_copy_only=False)
            for k in np.unique(np.where(there, ids, -1)).tolist():
                own = np.flatnonzero(there & (ids == k)) if k >= 0 else np.flatnonzero(~there | (ids < 0))
                part = batch.take(pa.array(own))
                if k < 0:
                    # a code without a codec can't be read; nothing at all is a miss
                    status = np.where(there[own], BROKEN, MISSING)
                    pages = pa.nulls(len(own), pa.binary())
                else:
                    pages, status = _decoded(CODEC_NAMES.get(k), part.column(code))
                yield pa.RecordBatch.from_arrays(
                    [*(c for at, c in enumerate(part.columns) if at != code), pages, pa.array(status.astype(np.int32))], [*(f.name for f in keys), "page", "status"])

    return entries.mapInArrow(run, f"{_ddl(keys)}, page binary, status int")


def _decoded(codec: str | None, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pages and statuses of the codes of one codec; where a batch can't be decoded, its codes are tried one by one."""
    data, offsets = _flat(column)
    errors = (ValueError, IndexError, KeyError, OSError, RuntimeError)
    try:
        pages = bytes_of.decoded(codec, data, offsets)
        return _binary(pages.ravel(), np.arange(len(column) + 1) * PAGE), np.zeros(len(column))
    except errors:
        out, status = [], np.full(len(column), BROKEN)
        for k in range(len(column)):
            try:
                out.append(bytes_of.decoded(codec, *bytes_of.taken(data, offsets, np.array([k])))[0].tobytes())
                status[k] = FOUND
            except errors:
                out.append(None)
        return pa.array(out, pa.binary()), status
