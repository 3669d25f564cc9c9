"""Quality classifier: supervised subword embeddings.

Every word, its character n-grams and a mark for a word that repeats the one
before are hashed to learned vectors; a document is the average of them, and a
softmax over two classes follows. It is trained by numpy stochastic gradient
descent on a bounded sample of labelled documents, and scored on whole texts.

Since the output is linear in the average, a bucket's share of the score is one
number. The n-grams of all texts of a batch are hashed at once, from their bytes.

An empty or null text has no features and gets the bias's score; a text of any
length is scored as a whole. Labels that are null are ignored; for several labels
of a document the lowest counts, and of several texts with its id one, whatever
their order. Without any label of either class the score is that share of labels,
or a half. A null doc_id isn't held out, and has no label. Repeated rows are scored
each. An empty table gives no rows. Extra columns are ignored by the query and kept
by ``score``, which replaces ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import CASED, SPACES, column, mixed, slices, word_hashes, word_places

BUCKETS = 1 << 17
DIM = 16
GRAMS = (3, 4)
EPOCHS = 8
RATE = 0.4
#: Documents that the classifier is fitted on: those with the least hashes.
SAMPLE = 4000
THRESHOLD = 0.7
#: Weight of the mark for a word that repeats the one before, whose bucket is the last.
REPEATED = 8
#: Bytes of words whose n-grams are hashed at once; a longer word alone.
AT_ONCE = 1 << 18
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def bucketed(hashes: np.ndarray) -> np.ndarray:
    """Buckets of hashes, but for the last one."""
    return (mixed(hashes) >> np.uint64(16)).astype(np.int64) % (BUCKETS - 1)


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, bucket) of words, n-grams of words between brackets, and marks, in parts."""
    hashes = word_hashes(texts, cased=True)
    owner = np.repeat(np.arange(len(texts)), [len(h) for h in hashes])
    yield owner, bucketed(np.concatenate(hashes) ^ np.uint64(1) if hashes else np.zeros(0, np.uint64))
    again = np.array([REPEATED * int((h[1:] == h[:-1]).sum()) for h in hashes], np.int64)
    yield np.repeat(np.arange(len(texts)), again), np.full(again.sum(), BUCKETS - 1)
    data, starts, ends, _ = word_places(texts)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + AT_ONCE, "right")))
        sizes = ends[low:high] - starts[low:high]
        first = np.cumsum(sizes + 2) - sizes - 2
        total = int(first[-1] + sizes[-1] + 2)
        # the words, each between two brackets
        padded = np.full(total, ord("<"), np.uint8)
        inside = np.ones(total, bool)
        inside[first] = inside[first + sizes + 1] = False
        padded[first + sizes + 1] = ord(">")
        own = data[starts[low]:ends[high - 1]]
        padded[inside] = own[~np.take(SPACES, own)]
        values, word = np.take(CASED, padded), np.repeat(np.arange(low, high), sizes + 2)
        for n in GRAMS:
            if total >= n:
                h = values[:total - n + 1].copy()
                for k in range(1, n):
                    h *= _FACTOR
                    h += values[k:total - n + 1 + k]
                whole = word[:total - n + 1] == word[n - 1:]
                yield owner[word[:total - n + 1][whole]], bucketed(h[whole] + np.uint64(n))
        low = high


def sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for doc, y, text in zip(*(c.to_pylist() for c in batch.columns)):
            buckets, counts = np.unique(np.concatenate([b for _, b in pieces([text])]), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc], pa.int64()), pa.array([y], pa.int32()), pa.array([buckets.astype(np.int32)], pa.list_(pa.int32())), pa.array([counts.astype(np.int32)], pa.list_(pa.int32()))],
                ["doc_id", "y", "buckets", "counts"])


class Model:
    """One score for each bucket, and a bias."""

    def __init__(self, shares: np.ndarray, bias: float) -> None:
        self.shares, self.bias = shares, bias

    @classmethod
    def fit(cls, docs: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
        """docs: (label, buckets, counts)."""
        n, good = len(docs), sum(y for y, _, _ in docs)
        if not 0 < good < n:
            p = (good + 0.5) / (n + 1.0)
            return cls(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
        rng = np.random.default_rng(seed)
        vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
        steps, done = EPOCHS * n, 0
        for _ in range(EPOCHS):
            for k in rng.permutation(n):
                y, buckets, counts = docs[k]
                rate = RATE * (1 - done / steps)
                done += 1
                weights = counts / max(1.0, counts.sum())
                hidden = weights @ vectors[buckets]
                logits = hidden @ out + bias
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[y] -= 1
                back = out @ p
                out -= rate * np.outer(hidden, p)
                bias -= rate * 0.1 * p
                # a document's step is shared by its pieces, as if each were its own
                vectors[buckets] -= (rate * np.minimum(1.0, weights * len(weights)))[:, None] * back
        shares = vectors @ (out[:, 1] - out[:, 0])
        return cls(shares.astype(np.float32), float(bias[1] - bias[0]))


    def scores(self, texts: list[str | None]) -> np.ndarray:
        total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for owner, buckets in pieces(texts):
            total += np.bincount(owner, np.take(self.shares, buckets), len(texts))
            n += np.bincount(owner, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(1, n) + self.bias, -60, 60)))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` documents that have a label and aren't held out."""
    doc_id = F.col("doc_id")
    labelled = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    chosen = labelled.where(~held_out(doc_id)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text")).join(
        F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(
        sample_features, "doc_id long, y int, buckets array<int>, counts array<int>")

    def fit(batches: Iterator[pa.RecordBatch]):
        sampled = {}
        for batch in slices(batches):
            for doc, y, buckets, counts in zip(*batch.columns):
                own = (int(y.as_py() > 0), buckets.values.to_numpy().astype(np.int64), counts.values.to_numpy().astype(np.float32))
                key = (own[1].tobytes(), own[2].tobytes())
                if doc.as_py() not in sampled or key < sampled[doc.as_py()][0]:
                    sampled[doc.as_py()] = key, own
        model = Model.fit([sampled[doc][1] for doc in sorted(sampled)])
        yield pa.RecordBatch.from_arrays([pa.array([model.shares.astype(np.float32).tobytes()], pa.binary()), pa.array([model.bias])], ["shares", "bias"])

    # the sample is bounded, so one task fits the model; the driver gets the buckets' shares alone
    found = rows.repartition(1).mapInArrow(fit, "shares binary, bias double").first()
    return Model(np.frombuffer(found["shares"], np.float32), found["bias"]) if found else Model.fit([])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, and all that ``docs`` has besides."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            scores = pa.array(sent.value.scores(batch.column(at).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
