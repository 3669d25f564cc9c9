"""Substring dedup by content-defined chunks.

A gear hash rolls over a text's bytes, and a chunk ends where its low bits are
zero, so an insertion shifts the chunks around it only. A chunk has a least and a
greatest size; what is left at a text's end belongs to the last chunk, so only a
whole text can be shorter. Chunks are compared by a 96-bit digest. A digest's
first place is the least (doc_id, text hash, start); chunks anywhere else are
repeats, and every repeat is removed from its text.

Digests are counted by their first 64 bits before anything else, and a filter of
bounded size holds those that come again, so that only chunks that may be repeats
are compared in full. Those are aggregated before they are joined back, so a
passage that stands in a third of all documents is one row; the join is one that
Spark splits.

An empty text has no chunks and stays; so does a null text. A text of any length
is cut as a whole. Repeated rows are the same document: each gets its result, and
of documents with equal texts the least doc_id keeps it. An empty table gives no
rows. Extra columns stay; ``n_repeated``, ``spans`` and ``removed_bytes`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column, materialize, mixed, slices

LEAST, MASK, MOST = 24, 31, 96
#: Bits of the filter of digests that come again: at most, and for each digest. A fuller filter lets more chunks through, and the result stays exact.
FILTER_BITS, BITS_A_KEY = 1 << 27, 8
#: A place is a chunk's start, with its length in the low bits.
LENGTH_BITS = 8
GEAR = (mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: h = 2 h + G[byte], in 32 bits, by doubling the width."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if k < len(h):
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks; none is inside a UTF-8 character."""
    n = len(data)
    if not n:
        return []
    values = np.frombuffer(data, np.uint8)
    inside = (values & 0xC0) == 0x80
    ends = np.flatnonzero((gear_hash(values) >> np.uint32(27)) & np.uint32(MASK) == 0) + 1
    ends = ends[ends < n]
    ends = ends[~inside[ends]].tolist()
    out, start, k = [], 0, 0
    while n - start > LEAST:
        while k < len(ends) and ends[k] < start + LEAST:
            k += 1
        end = ends[k] if k < len(ends) else n
        if end > start + MOST:
            end = start + MOST
            while end < n and inside[end]:
                end += 1
        if n - end < LEAST:  # no chunk is shorter
            break
        out.append(end)
        start = end
    return [*out, n]


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ids, hashes, places, digests = [], [], [], []
        for doc, h, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not text:
                continue
            data, start = text.encode("utf-8", "surrogatepass"), 0
            for end in cuts(data):
                digest = xxhash.xxh3_128_digest(data[start:end])[:12]
                ids.append(doc)
                hashes.append(h)
                places.append(start << LENGTH_BITS | end - start)
                digests.append(digest)
                start = end
            if len(ids) > 50_000:
                yield _chunks(ids, hashes, places, digests)
                ids, hashes, places, digests = [], [], [], []
        yield _chunks(ids, hashes, places, digests)


def _chunks(ids, hashes, places, digests) -> pa.RecordBatch:
    three = np.frombuffer(b"".join(digests), "<i4").reshape(-1, 3)
    a = np.ascontiguousarray(three[:, :2]).view(np.int64).ravel()
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(hashes, pa.int32()), pa.array(places, pa.int64()), pa.array(a), pa.array(np.ascontiguousarray(three[:, 2]))],
        ["doc_id", "h", "place", "a", "b"])


def merged(places: list[int]) -> list[tuple[int, int]]:
    """Spans of chunks in a row."""
    out: list[list[int]] = []
    for place in sorted(places):
        s, n = place >> LENGTH_BITS, place & (1 << LENGTH_BITS) - 1
        if out and out[-1][1] == s:
            out[-1][1] = s + n
        else:
            out.append([s, s + n])
    return [(s, e) for s, e in out]


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, n): the first 64 bits of the chunks' digests, counted by parts of a task."""
    waiting, size = [], 0

    def counted() -> pa.RecordBatch:
        a, n = np.unique(np.concatenate(waiting), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(n.astype(np.int64))], ["a", "n"])

    for batch in chunk_rows(batches):
        waiting.append(batch.column(3).to_numpy())
        size += batch.num_rows
        if size > 400_000:
            yield counted()
            waiting, size = [], 0
    if waiting:
        yield counted()


def repeated_filter(texts: DataFrame) -> np.ndarray:
    """Bits, in words of 64, of the digests that come again; the number of bits is a power of two."""
    again = materialize(texts.mapInArrow(digests, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).where("n > 1").select("a"), "again")
    bits = min(FILTER_BITS, 1 << max(10, (BITS_A_KEY * again.count()).bit_length()))
    spot = F.col("a").bitwiseAND(F.lit(bits - 1))
    rows = again.select(F.shiftrightunsigned(spot, 6).alias("word"), F.expr(f"shiftleft(1L, int(a & 63))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))

    def packed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(k).to_numpy().astype(np.int64).tobytes()], pa.binary()) for k in (0, 1)], ["words", "bits"])

    out = np.zeros(bits // 64, np.int64)
    for r in rows.mapInArrow(packed, "words binary, bits binary").toLocalIterator():  # bytes, a batch at a time
        out[np.frombuffer(r["words"], np.int64)] = np.frombuffer(r["bits"], np.int64)
    return out.view(np.uint64)


def dedup_chunks(docs: DataFrame) -> DataFrame:
    """docs without repeated passages, with n_repeated, removed_bytes and spans (byte ranges of the text before)."""
    docs = docs.drop("n_repeated", "spans", "removed_bytes")
    keyed = docs.withColumns({"__id": column(docs, "doc_id", "long"), "__h": F.hash("text")})
    # cutting the texts again costs less than a table of all chunks
    texts = keyed.select("__id", "__h", "text")
    sent = docs.sparkSession.sparkContext.broadcast(repeated_filter(texts))

    def maybe(batches: Iterator[pa.RecordBatch]):
        words = sent.value
        for batch in chunk_rows(batches):
            spot = batch.column(3).to_numpy().view(np.uint64) & np.uint64(64 * len(words) - 1)
            yield batch.filter(pa.array((words[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) == 1))

    chunks = materialize(texts.mapInArrow(maybe, "doc_id long, h int, place long, a long, b int"), "chunks")
    firsts = chunks.groupBy("a", "b").agg(F.min(F.struct("doc_id", "h", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
    # a table of its own, so that the join has a shuffle that Spark may split where a digest is hot
    firsts = materialize(firsts.drop("n"), "firsts")
    later = chunks.join(firsts, ["a", "b"]).where(~F.struct("doc_id", "h", "place").eqNullSafe(F.col("first"))).dropDuplicates(["doc_id", "h", "place"])
    found = later.groupBy(F.col("doc_id").alias("__doc"), F.col("h").alias("__hash")).agg(F.collect_list("place").alias("__later"))
    joined = keyed.join(found, F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__h") == F.col("__hash")), "left").select(*docs.columns, "__later")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            texts, repeated, spans, removed = [], [], [], []
            for text, later in zip(batch.column(at).to_pylist(), batch.column(len(docs_columns)).to_pylist()):
                data = text.encode("utf-8", "surrogatepass") if later else b""
                own = merged(later) if later else []
                if own:
                    kept, last = [], 0
                    for s, e in own:
                        kept.append(data[last:s])
                        last = e
                    text = b"".join([*kept, data[last:]]).decode("utf-8", "surrogatepass")
                texts.append(text)
                repeated.append(len(later or ()))
                spans.append(",".join(f"{s}:{e}" for s, e in own))
                removed.append(sum(e - s for s, e in own))
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(repeated, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.string())],
                                             [*docs_columns, "n_repeated", "removed_bytes", "spans"])

    docs_columns = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(run, f"{fields}, n_repeated long, removed_bytes long, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_chunks(docs).select("doc_id", "n_repeated", "removed_bytes", "spans", "text")
