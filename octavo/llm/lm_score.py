"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

The words that come most often, and the end of a text, are dealt into classes by
rank, and a word's probability is that of its class times its own within the
class. All other words form one more class, a tree: a word's hash names its path
through levels of 32 branches, whose number grows with the vocabulary, and words
of one leaf share it by their smoothed counts. Each choice is a softmax over
hashed features: the word before, the one before that (a skip) and, for the class,
both together, where any word is a context of its own. A word that isn't known
has its smoothed count's share of the last class, so the probabilities of all
known words and of one unknown sum to one.

Every training document counts. Documents are dealt into shards by a hash of
their id and text, as many as the corpus's tokens ask for. Adaptive gradient steps
run over each shard in the order of the hashes, and the weights of all shards are
averaged in proportion to their tokens, with a bounded fan-in. A larger corpus has
more rounds, over shards of their own, and each begins with the weights of the one
before. So the weights depend on the documents alone and not on how Spark splits
them. The feature rows grow with the vocabulary. Counts of words are exact up to
equal 64-bit hashes. The most frequent words' counts are broadcast up to a bound;
the rest are joined.

A null or empty text is one end token. Without training documents every base
probability is one. A null doc_id isn't held out. Repeated rows are scored each,
and each counts in training. A text of any length is one row of a shard. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column, materialize, mixed, slices, word_hashes

CLASSES, WIDTH = 32, 32
WORDS = CLASSES * WIDTH
#: Ids: the words of the classes, then any other word; the context before a text.
OTHER, BEFORE = WORDS, WORDS + 1
#: Branches of a choice in bits, most levels of the tree (the leaves' masses are broadcast), and words of a leaf before there is one more level.
BRANCH, LEVELS, LEAF = 5, 4, 64
#: Feature rows: at least, at most (the weights are broadcast), and the known words for each.
LEAST_ROWS, MOST_ROWS, WORDS_A_ROW = 1 << 14, 1 << 17, 16
#: Tokens that a task learns from for each row, so that the weights written stay in proportion to the text.
TOKENS_A_ROW = 48
#: Words whose counts are broadcast, and tokens that a task counts at once.
FREQUENT, COUNTED = 1 << 18, 500_000
BATCH, RATE, SMOOTH, BUCKET_BITS = 4096, 0.08, 0.1, 18
FAN_IN, PARTS, ROUNDS = 64, 16, 3
END_HASH = mixed(np.full(1, 3, np.uint64)).view(np.int64)[0]


def token_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Per text, the hashes of its words and of the end."""
    return [np.append(h.view(np.int64), END_HASH) for h in word_hashes(texts)]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, c): the tokens of the texts."""

    def run(batches: Iterator[pa.RecordBatch]):
        waiting, n = [], 0

        def rows() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c.astype(np.int64))], ["h", "c"])

        for batch in slices(batches):
            own = token_hashes(batch.column(0).to_pylist())
            waiting += own
            n += sum(map(len, own))
            if n > COUNTED:
                yield rows()
                n = 0
        if waiting:
            yield rows()

    return texts.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


MIX = tuple(mixed(np.arange(1, 7, dtype=np.uint64)) | np.uint64(1))


def levels_of(words: int) -> int:
    """Levels of the tree for so many words outside the classes: LEAF words a leaf at most, up to LEVELS."""
    return next((k for k in range(LEVELS) if words <= LEAF << BRANCH * k), LEVELS)


def rows_of(v: int) -> int:
    return min(MOST_ROWS, max(LEAST_ROWS, 1 << (v // WORDS_A_ROW).bit_length()))


def void(x: np.ndarray) -> np.ndarray:
    """The rows of a matrix as single values, which numpy puts back several times faster."""
    return x.view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()


def take(x: np.ndarray, rows: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    return np.take(x, rows, axis=0, out=out, mode="clip")


def put(x: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    np.put(void(x), rows, void(values), mode="clip")


def summed_by(rows: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and for each the sum of its rows of x: neighbours are added pair by pair."""
    order = np.argsort(rows.astype(np.uint16), kind="stable") if rows.max(initial=0) < 1 << 16 else np.argsort(rows, kind="stable")
    rows, x = rows[order], take(x, order)
    new = np.ones(len(rows), bool)
    np.not_equal(rows[1:], rows[:-1], out=new[1:])
    first = np.flatnonzero(new)
    rank = np.arange(len(rows)) - np.repeat(first, np.diff(first, append=len(rows)))
    live, step = np.flatnonzero(rank), 1
    rank = rank[live]
    while len(live):
        odd = rank & 1 == 1
        own = live[odd]
        total = take(x, own - step)
        total += take(x, own)
        put(x, own - step, total)
        live, rank, step = live[~odd], rank[~odd] >> 1, step * 2
    return rows[first], take(x, first)


class Model:
    """The counts that all tasks share, the priors, and the weights."""

    def __init__(self, frequent: pd.DataFrame, top: pd.DataFrame, n: int, v: int, leaves: np.ndarray | None = None) -> None:
        """leaves: the smoothed counts of the words outside the classes, summed by path; without, they are one leaf."""
        hashes, counts = frequent["h"].to_numpy(np.int64), frequent["c"].to_numpy(np.int64)
        order = np.argsort(hashes)
        #: By code: the hash, the log of the smoothed count, whether it is known; the last code is that of any other word.
        self.hashes = hashes[order]
        #: Where the hashes with each value of their first bits start, in the order of unsigned numbers.
        self.own = np.argsort(self.hashes.view(np.uint64))
        self.sorted = self.hashes[self.own]
        self.buckets = np.searchsorted(self.sorted.view(np.uint64) >> np.uint64(64 - BUCKET_BITS), np.arange((1 << BUCKET_BITS) + 1))
        self.logs = np.append(np.log10(counts[order] + SMOOTH), 0.0)
        self.known = np.append(counts[order] > 0, False)
        order = np.argsort(top["h"].to_numpy(np.int64))
        self.top, self.top_ids = top["h"].to_numpy(np.int64)[order], order
        self.n, self.v = n, v
        modelled = np.zeros(WORDS)
        modelled[:len(top)] = top["c"].to_numpy()
        live = np.arange(WORDS) < len(top)
        self.rest = n - modelled.sum() + SMOOTH * (v - len(top) + 1)
        mass = np.append(modelled.reshape(CLASSES, WIDTH).sum(1) + SMOOTH * live.reshape(CLASSES, WIDTH).sum(1), self.rest)
        leaves = np.array([self.rest - SMOOTH]) if leaves is None else leaves
        self.levels = (len(leaves).bit_length() - 1) // BRANCH
        tree = [leaves.reshape(1 << BRANCH * k, WIDTH, -1).sum(2) for k in range(self.levels)]
        shares = np.concatenate([np.where(live, modelled + SMOOTH, 0).reshape(CLASSES, WIDTH), *tree])
        with np.errstate(divide="ignore", invalid="ignore"):
            self.class_bias = np.where(mass > 0, np.log(mass / mass.sum()), -60).astype(np.float32)
            #: By choice: the classes', then the tree's, level by level.
            self.word_bias = np.where(shares > 0, np.log(shares / shares.sum(1, keepdims=True)), -60).astype(np.float32)
            #: Of a known word in the tree: the log of its leaf's share of a smoothed count of one.
            self.leaf_logs = np.where(leaves > 0, np.log10((self.rest - SMOOTH) / self.rest / leaves), 0).astype(np.float32)
        self.rows = rows_of(v)
        self.shift = np.uint64(65 - self.rows.bit_length())
        self.class_weights = np.zeros((self.rows, CLASSES + 1), np.float32)
        self.word_weights = np.zeros((self.rows, WIDTH), np.float32)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), OTHER, np.int64)
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, hashes), len(self.top) - 1)
            out = np.where(self.top[at] == hashes, self.top_ids[at], out)
        return out

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), len(self.hashes), np.int64)
        bucket = (hashes.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        at, end, live = self.buckets[bucket], self.buckets[bucket + 1], np.arange(len(hashes))
        while True:  # a bucket holds one hash or so
            inside = at < end
            live, at, end = live[inside], at[inside], end[inside]
            if not len(live):
                return out
            same = self.sorted[at] == hashes[live]
            out[live[same]] = self.own[at[same]]
            live, at, end = live[~same], at[~same] + 1, end[~same]

    def paths(self, hashes: np.ndarray) -> np.ndarray:
        """The leaf of each word: the first bits of its hash."""
        return (hashes.view(np.uint64) >> np.uint64(1) >> np.uint64(63 - BRANCH * self.levels)).astype(np.int64)

    def _hashed(self, x: np.ndarray) -> np.ndarray:
        return (((x ^ (x >> np.uint64(29))) * MIX[5]) >> self.shift).astype(np.intp)

    def class_features(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Rows for the word before, the one before that, and both."""
        a, b = one.astype(np.uint64) * MIX[0], two.astype(np.uint64) * MIX[1]
        return np.stack([self._hashed(a), self._hashed(b), self._hashed(a + b)])

    def word_features(self, choice: np.ndarray, *words: np.ndarray) -> list[np.ndarray]:
        """Rows within a choice for the word before, and the one before that if it is given."""
        c = choice.astype(np.uint64) * MIX[4]
        return [self._hashed(w.astype(np.uint64) * mix + c) for w, mix in zip(words, MIX[2:4])]

    def choices(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray, paths: np.ndarray | None) -> Iterator[tuple]:
        """After the class: (token, choice, branch, rows) of the words in classes and of the tree's first level, and of each level below.

        Below the first level the word before alone is a feature: there pairs of a context and a choice hardly come again.
        """
        parts, deeper = [], []
        own = np.flatnonzero(ids < OTHER)
        parts.append((own, ids[own] // WIDTH, ids[own] % WIDTH))
        if paths is not None and self.levels:
            own, before = np.flatnonzero(ids == OTHER), CLASSES
            path = paths[own]
            for k in range(self.levels):
                at = path >> BRANCH * (self.levels - k - 1)
                (deeper if k else parts).append((own, before + (at >> BRANCH), at & WIDTH - 1))
                before += 1 << BRANCH * k
        for found, words in ((parts, (one, two)), (deeper, (one,))):
            if found:
                token, choice, branch = (np.concatenate(x) for x in zip(*found))
                if len(token):
                    yield token, choice, branch, self.word_features(choice, *(w[token] for w in words))

    @staticmethod
    def _logits(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
        x = take(weights, rows[0])
        more = np.empty_like(x)
        for own in rows[1:]:
            x += take(weights, own, more)
        x += bias
        return x

    @staticmethod
    def softmax(x: np.ndarray) -> np.ndarray:
        np.exp(x, out=x)  # logits are log shares and a few adaptive steps, far from the range's end
        x *= (1 / (x @ np.ones(x.shape[1], np.float32)))[:, None]
        return x

    @staticmethod
    def _own(x: np.ndarray, branch: np.ndarray) -> np.ndarray:
        """The logs of the branches' shares; x is spent."""
        own = x.ravel()[np.arange(len(x)) * x.shape[1] + branch].astype(np.float64)
        return own - np.log(np.exp(x, out=x) @ np.ones(x.shape[1], np.float32))

    def _logs(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray, paths: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs of the class, and of the choices after it."""
        rows = self.class_features(one, two)
        cls = self._own(self._logits(self.class_weights, rows, self.class_bias), ids // WIDTH)
        words = np.zeros(len(ids))
        for token, choice, branch, rows in self.choices(ids, one, two, paths):
            words += np.bincount(token, self._own(self._logits(self.word_weights, rows, take(self.word_bias, choice)), branch), len(ids))
        return cls, words

    def log_probabilities(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray, paths: np.ndarray | None = None) -> np.ndarray:
        """Natural logs; of any other word, that of its class and, with paths, of its leaf."""
        return np.add(*self._logs(ids, one, two, paths))

    def scored(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logs (10) of the words in classes and of the tree's class, and of the leaves within it."""
        cls, own = self._logs(ids, one, two, paths)
        tree = ids == OTHER
        return (cls + np.where(tree, 0, own)) / np.log(10), np.where(tree, own, 0) / np.log(10)

    def learn(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray, paths: np.ndarray, sums: tuple[np.ndarray, np.ndarray]) -> None:
        """One adaptive gradient step."""
        rows = self.class_features(one, two)
        p = self.softmax(self._logits(self.class_weights, rows, self.class_bias))
        p[np.arange(len(ids)), ids // WIDTH] -= 1
        self._step(self.class_weights, sums[0], rows, p)
        for token, choice, branch, rows in self.choices(ids, one, two, paths):
            p = self.softmax(self._logits(self.word_weights, rows, take(self.word_bias, choice)))
            p[np.arange(len(token)), branch] -= 1
            self._step(self.word_weights, sums[1], rows, p)

    @staticmethod
    def _step(weights: np.ndarray, sums: np.ndarray, rows: np.ndarray, slope: np.ndarray) -> None:
        for own in rows:
            row, g = summed_by(own, slope)
            total = take(sums, row)
            total += g * g
            put(sums, row, total)
            g *= RATE
            g /= np.sqrt(total, out=total)
            put(weights, row, take(weights, row) - g)


def contexts(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each, and the one before that, within texts that begin at the starts."""
    one, two = np.empty_like(hashes), np.empty_like(hashes)
    one[1:], two[2:] = hashes[:-1], hashes[:-2]
    two[:2] = one[starts] = two[starts] = BEFORE
    two[np.minimum(starts + 1, len(hashes) - 1)] = BEFORE
    return one, two


def flat(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(texts), np.cumsum([0] + [len(t) for t in texts[:-1]])


def trained(docs: DataFrame, model: Model) -> Model:
    """The model with weights from one pass over all documents, in rounds over shards of their own."""
    shards = max(1, -(-model.n // (TOKENS_A_ROW * model.rows)))
    rounds = min(ROUNDS, (shards.bit_length() + 1) // 2)
    key = F.xxhash64("doc_id", "text")
    rows = docs.select(F.pmod(key, F.lit(shards)).alias("shard"), key.alias("key"), "text")
    for k in range(rounds):
        own = rows.where(f"shard % {rounds} = {k}").repartitionById(-(-shards // rounds), F.expr(f"int(shard div {rounds})"))
        improved(own.sortWithinPartitions("shard", "key"), model)
    return model


def improved(shards: DataFrame, model: Model) -> None:
    """The model's weights become those of a pass over the shards, whose rows come in order, that begins with them."""
    sent = shards.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        own, last, waiting, n, tokens = None, None, [], 0, 0

        def begun() -> Model:
            out = copy.copy(sent.value)
            out.class_weights, out.word_weights = out.class_weights.copy(), out.word_weights.copy()
            return out

        def learn() -> int:
            hashes, starts = flat(waiting)
            parts = (own.ids(hashes), *contexts(hashes, starts), own.paths(hashes))
            for k in range(0, len(hashes), BATCH):
                own.learn(*(x[k:k + BATCH] for x in parts), sums)
            waiting.clear()
            return len(hashes)

        def blocks() -> Iterator[pa.RecordBatch]:
            for part in range(PARTS):
                block = np.concatenate([w[part::PARTS].ravel() for w in (own.class_weights, own.word_weights)]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([part], pa.int32()), pa.array([float(tokens)]), pa.array([block.tobytes()], pa.binary())],
                                                 ["shard", "part", "weight", "block"])

        for batch in slices(batches):
            for shard, hashes in zip(batch.column(0).to_pylist(), token_hashes(batch.column(2).to_pylist())):
                if shard != last:
                    if own is not None:
                        tokens, n = tokens + learn() if waiting else tokens, 0
                        yield from blocks()
                    own, last, tokens = begun(), shard, 0
                    sums = (np.full_like(own.class_weights, 1.0), np.full_like(own.word_weights, 1.0))
                waiting.append(hashes)
                n += len(hashes)
                if n >= BATCH:
                    tokens, n = tokens + learn(), 0
        if own is not None:
            tokens += learn() if waiting else 0
            yield from blocks()

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        total, weight = None, rows["weight"].sum()
        for w, b in zip(rows["weight"], rows["block"]):
            share = np.frombuffer(b, np.float16) * np.float32(w / weight)
            total = share if total is None else total + share
        return pd.DataFrame({"shard": [rows["shard"].iloc[0] // FAN_IN], "part": [rows["part"].iloc[0]], "weight": [weight], "block": [total.astype(np.float16).tobytes()]})

    shape = "shard long, part int, weight double, block binary"
    blocks = materialize(shards.mapInArrow(run, shape), "weights")
    last = blocks.agg(F.max("shard")).first()[0]
    while last:
        blocks = materialize(blocks.groupBy(F.expr(f"shard div {FAN_IN}"), "part").applyInPandas(mean, shape), "weights")
        last //= FAN_IN
    for r in blocks.collect():
        block = np.frombuffer(r["block"], np.float16)
        n = model.rows // PARTS * (CLASSES + 1)
        model.class_weights[r["part"]::PARTS] = block[:n].reshape(-1, CLASSES + 1)
        model.word_weights[r["part"]::PARTS] = block[n:].reshape(-1, WIDTH)
    sent.destroy()


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: the sums over the words whose counts are broadcast, and the other words' hashes with the logs of their leaves."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    shape = "row long, doc_id long, n_tokens long, n_known long, logs double, model double, cold array<long>, leaves array<float>"

    def run(batches: Iterator[pa.RecordBatch]):
        model, task, at = sent.value, TaskContext.get().partitionId(), 0
        kinds = [pa.int64()] * 4 + [pa.float64()] * 2 + [pa.list_(pa.int64()), pa.list_(pa.float32())]
        names = [f.split()[0] for f in shape.split(", ")]

        def sums(waiting: list[np.ndarray]) -> Iterator[list]:
            """Per text: known tokens, logs, the model's logs; of tokens without a broadcast count, hashes and logs of leaves."""
            hashes, starts = flat(waiting)
            codes, parts = model.codes(hashes), (model.ids(hashes), *contexts(hashes, starts))
            paths, logs = model.paths(hashes), model.logs[codes]
            tree = parts[0] == OTHER
            cold = np.flatnonzero(codes == len(model.hashes))
            cut = np.searchsorted(cold, starts[1:])
            own, leaves = [np.empty(len(hashes)) for _ in range(2)]
            for k in range(0, len(hashes), BATCH):
                own[k:k + BATCH], leaves[k:k + BATCH] = model.scored(*(x[k:k + BATCH] for x in (*parts, paths)))
            leaves[tree] += model.leaf_logs[paths[tree]]
            own += np.where(tree & model.known[codes], leaves + logs, 0)
            for x in (model.known[codes].astype(np.int64), logs, own):
                yield np.add.reduceat(x, starts)
            yield np.split(hashes[cold], cut)
            yield np.split(leaves[cold].astype(np.float32), cut)

        for batch in slices(batches):
            waiting, size, parts = [], 0, []
            docs = batch.column(0).to_pylist()
            for hashes in token_hashes(batch.column(1).to_pylist()):
                waiting.append(hashes)
                size += len(hashes)
                if size >= BATCH:
                    parts += zip(map(len, waiting), *sums(waiting))
                    waiting, size = [], 0
            if waiting:
                parts += zip(map(len, waiting), *sums(waiting))
            rows = range((task << 36) + at, (task << 36) + at + len(docs))
            at += len(docs)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((rows, docs, *zip(*parts)), kinds)], names)

    return docs.mapInArrow(run, shape)


def leaves(vocabulary: DataFrame, top: pd.DataFrame, v: int) -> np.ndarray | None:
    """The smoothed counts of the words outside the classes, by leaf."""
    levels = levels_of(v - len(top))
    if not levels:
        return None
    path = lambda h: F.shiftrightunsigned(h, 64 - BRANCH * levels)
    block = 1 << BRANCH * min(levels, 3)

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.bincount(rows["leaf"] % block, rows["mass"], block)
        return pd.DataFrame({"block": rows["leaf"].iloc[:1] // block, "masses": [own.tobytes()]})

    # a million rows would fill the driver: blocks of leaves reach it as bytes
    found = vocabulary.groupBy(path(F.col("h")).alias("leaf")).agg(F.sum(F.col("c") + SMOOTH).alias("mass"))
    out = np.zeros(1 << BRANCH * levels)
    for r in found.groupBy(F.expr(f"leaf div {block}")).applyInPandas(packed, "block long, masses binary").collect():
        out[r["block"] * block:(r["block"] + 1) * block] = np.frombuffer(r["masses"])
    own = top["h"].to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - BRANCH * levels)
    np.subtract.at(out, own.astype(np.int64), top["c"].to_numpy() + SMOOTH)
    return np.where(out > SMOOTH / 2, out, 0)


def scores(docs: DataFrame) -> DataFrame:
    """The base and the model's score of every document."""
    docs = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    training = docs.where(~held_out(F.col("doc_id")))
    vocabulary = materialize(word_counts(training), "counts")
    totals = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(totals["n"]), int(totals["v"])
    sizes = vocabulary.groupBy(F.least("c", F.lit(5000)).alias("c")).agg(F.count("*").alias("k")).toPandas().sort_values("c", ascending=False)
    fits = sizes[sizes["k"].cumsum() <= FREQUENT]
    least = int(fits["c"].min()) if len(fits) else 1 << 62
    # words as common as 5000 are many only in a very large corpus: then only the very first are broadcast
    top = vocabulary.orderBy(F.desc("c"), "h").limit(WORDS).toPandas()
    frequent = vocabulary.where(F.col("c") >= least).toPandas()
    frequent = pd.concat([frequent, top]).drop_duplicates("h")
    model = trained(training, Model(frequent, top, n, v, leaves(vocabulary, top, v)))
    rows = materialize(scored(docs, model), "scores")
    smoothed = F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)
    rest = float(np.log10(model.rest)) if model.rest > 0 else 0.0
    cold = rows.select("row", F.explode(F.arrays_zip("cold", "leaves")).alias("x")).select("row", F.col("x.cold").alias("h"), F.col("x.leaves").alias("leaf"))
    cold = cold.join(vocabulary, "h", "left").groupBy("row").agg(
        F.sum(smoothed).alias("cold_logs"), F.count("c").alias("cold_known"),
        F.sum(smoothed + F.when(F.col("c").isNotNull(), F.col("leaf")).otherwise(-rest)).alias("cold_model"))
    base = float(np.log10(n + SMOOTH * (v + 1)))
    found = F.coalesce("cold_logs", F.lit(0.0))
    return rows.join(cold, "row", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("cold_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + found - F.col("n_tokens") * base).alias("base_score"),
        (F.col("model") + F.coalesce("cold_model", F.lit(0.0))).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
