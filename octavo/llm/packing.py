"""Packing token sequences by non-negative least squares.

Whole windows of a document fill sequences of their own. What is left of each
document is a length below the window. Combinations of two or three lengths
that fill a window are enumerated, and the number of times to use each is the
non-negative least-squares fit to the histogram of the lengths. The rounded
solution packs most pieces uncut; what it leaves is packed greedily, longest
first, by filling each window from the next piece and cutting it at the edge.
The last, short window is cut into powers of two, which need no padding.

Only the histogram (one count for each length below the window) comes to the
driver, so the plan's size doesn't depend on the corpus.

A null or empty text is one end token, and a text of any length is tokenized as a
whole. Repeated rows are packed each. Which of equally long rests comes first goes
by task and place, so sequence ids, unlike pieces' ids, depend on how the table is
split. Extra columns are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column, materialize, slices

WINDOW = 1024
END = 0
TOKENIZER = "byte_bpe_50k"
#: Of combinations of three, the shortest length is one of so many.
SHORT = 24
#: Sequence ids of whole windows start here.
WHOLE = 1 << 62
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_encoders: dict[str, object] = {}


def encoder(name: str = TOKENIZER):
    """A function from text to ids: those of the tokenizers file of that name.

    The ranks in tiktoken's form give the same ids in a fifth of the time; a
    special token's string in a text is that token, as it is there. Its pattern
    gives up on white space of hundreds of thousands of characters in a row; the
    tokenizers library itself encodes such a text.
    """
    if name not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        coder = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        exact = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))

        def encode(text: str) -> list[int]:
            try:
                return coder.encode(text, allowed_special="all", disallowed_special=())
            except ValueError:
                return exact.encode(text, add_special_tokens=False).ids

        _encoders[name] = encode
    return _encoders[name]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenized(docs: DataFrame, window: int, name: str) -> DataFrame:
    """Per document: the checksums of its whole windows, the rest, and the rest's rank among those of its length in its task."""

    def run(batches: Iterator[pa.RecordBatch]):
        encode, ranks, task, local = encoder(name), defaultdict(int), TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            out: dict[str, list] = {k: [] for k in ("doc_id", "doc_tokens", "whole", "task", "first", "rest", "rank", "ids")}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array(encode(text or "") + [END], np.uint32)
                full = len(ids) // window
                rest = len(ids) - full * window
                out["doc_id"].append(doc)
                out["doc_tokens"].append(len(ids))
                out["whole"].append([crc(ids[k * window:(k + 1) * window]) for k in range(full)])
                out["task"].append(task)
                out["first"].append(local)
                out["rest"].append(rest)
                out["rank"].append(ranks[rest])
                out["ids"].append(ids[full * window:].astype("<u4").tobytes())
                ranks[rest] += 1
                local += full
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("whole", pa.list_(pa.int64())), ("task", pa.int64()),
                        ("first", pa.int64()), ("rest", pa.int64()), ("rank", pa.int64()), ("ids", pa.binary())])
    return docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text")).mapInArrow(
        run, "doc_id long, doc_tokens long, whole array<long>, task long, first long, rest long, rank long, ids binary")


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths, in falling order, that fill the window; of two, the last is 0."""
    there = histogram > 0
    n = np.arange(1, window)
    a, b = n[n * 2 >= window], window - n[n * 2 >= window]
    found = [np.stack([a, b, np.zeros_like(a)], 1)]
    short = np.argsort(-histogram[1:window // 3 + 1] * np.arange(1, window // 3 + 1), kind="stable")[:SHORT] + 1
    for c in sorted(short):
        b = n[(n >= c) & (2 * n <= window - c)]
        found.append(np.stack([window - c - b, b, np.full_like(b, c)], 1))
    out = np.unique(np.concatenate(found), axis=0)
    return out[there[out[:, 0]] & there[out[:, 1]] & (there[out[:, 2]] | (out[:, 2] == 0))]


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x with the least squared error of sum x_j column_j against target, by accelerated projected gradients."""
    x = y = np.zeros(len(columns))
    used = columns > 0
    degree = np.bincount(columns[used], minlength=len(target))
    step, t = 1.0 / max(1.0, 3.0 * degree.max(initial=1)), 1.0
    for _ in range(rounds):
        made = np.bincount(columns.ravel(), np.repeat(y, 3), len(target))
        error = (target - made) * (np.arange(len(target)) > 0)
        new = np.maximum(0, y + step * error[columns].sum(1))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, x = new + (last - 1) / t * (new - x), new
    return x


class Plan:
    """From (length, rank) to places in sequences."""

    def __init__(self, histogram: np.ndarray, window: int = WINDOW) -> None:
        self.window = window
        left = histogram.astype(np.int64).copy()
        left[0] = 0
        columns = combinations(left, window)
        x = nnls(columns, left.astype(float)) if len(columns) else np.zeros(0)
        taken = np.zeros(window, np.int64)
        slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        sequence = 0
        for j in np.argsort(-x, kind="stable"):
            lengths = [int(v) for v in columns[j] if v]
            times = min([round(float(x[j])), *(int(left[v]) // lengths.count(v) for v in lengths)])
            if times <= 0:
                continue
            offset = 0
            for v in lengths:
                slots[v].append((int(taken[v]), sequence, offset))
                taken[v] += times
                left[v] -= times
                offset += v
            sequence += times
        self.taken = taken
        self.slots = {v: np.array(s, np.int64) for v, s in slots.items()}
        order = np.arange(window - 1, 0, -1)
        self.run = np.zeros(window, np.int64)
        self.run[order] = np.cumsum(left[order] * order) - left[order] * order
        self.base, self.total = sequence, int((left * np.arange(window)).sum())
        tail = self.total % window
        powers = [1 << k for k in range(window.bit_length(), -1, -1) if tail >> k & 1]
        self.tail = self.total - tail
        self.edges = [self.tail + sum(powers[:k]) for k in range(len(powers) + 1)]

    def places(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the piece, length, sequence, offset) of what becomes of it."""
        if rank < self.taken[length]:
            own = self.slots[length]
            first, sequence, offset = own[np.searchsorted(own[:, 0], rank, "right") - 1]
            return [(0, length, int(sequence + rank - first), int(offset))]
        at = int(self.run[length] + (rank - self.taken[length]) * length)
        end, begun, out = at + length, at, []
        while at < end:
            if at < self.tail:
                low, sequence = at // self.window * self.window, at // self.window
                high = low + self.window
            else:
                k = int(np.searchsorted(self.edges, at, "right")) - 1
                low, high, sequence = self.edges[k], self.edges[k + 1], self.tail // self.window + k
            stop = min(end, high)
            out.append((at - begun, stop - at, self.base + sequence, at - low))
            at = stop
        return out


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER) -> DataFrame:
    """The pieces of all documents, with the sequence and the place of each."""
    rows = materialize(tokenized(docs, window, tokenizer), "tokens")
    counts = materialize(rows.groupBy("task", "rest").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(window, np.int64)
    for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect():
        histogram[r["rest"]] = r["n"]
    plan = rows.sparkSession.sparkContext.broadcast(Plan(histogram, window))
    earlier = counts.select("task", "rest", F.expr(
        "sum(n) OVER (PARTITION BY rest ORDER BY task) - n").alias("earlier"))
    # the counts grow with the tasks: a join that shuffles, whatever their size
    placed = rows.join(earlier.hint("shuffle_hash"), ["task", "rest"]).select(
        "doc_id", "doc_tokens", "whole", "task", "first", "rest", (F.col("rank") + F.col("earlier")).alias("rank"), "ids")

    def run(batches: Iterator[pa.RecordBatch]):
        names = [f.split()[0] for f in PIECES.split(", ")]
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, tokens, whole, task, first, rest, rank, ids in zip(*(c.to_pylist() for c in batch.columns)):
                for k, sum_ in enumerate(whole):
                    out.append((doc, k * window, window, sum_, tokens, WHOLE + (task << 36) + first + k, 0))
                if rest:
                    values = np.frombuffer(ids, "<u4")
                    for at, length, sequence, offset in plan.value.places(rest, rank):
                        out.append((doc, len(whole) * window + at, length, crc(values[at:at + length]), tokens, sequence, offset))
            columns = zip(*out) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return placed.mapInArrow(run, PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
