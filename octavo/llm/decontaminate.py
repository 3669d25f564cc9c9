"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of lower-cased words (runs of
letters, digits and underscores). A document that shares a seed of five words
with an item is a candidate. Its tiling is greedy: Karp-Rabin fingerprints of a
search length find equal stretches of words that aren't marked yet, the longest
are marked first, and the search length falls until it is that of a seed. An
item of which at least half the words are marked is contained, in whatever
order its parts come.

An item of fewer words than a seed is contained where all its words stand in a row.

The benchmark is dealt into blocks of a bounded number of characters; each
block is broadcast and passed over all documents, so nothing else is shuffled,
and a task holds one block at a time.

An item without words matches nothing, and null and empty texts have no words. Of
equal matches the first in the item, then in the document, is marked first. A
text of any length is tiled as a whole. Repeated rows are reported each, and so
are items that come again. Empty tables give no pairs. Extra columns are ignored
by ``contained`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column, materialize, mixed, slices

SEED = 5
COVERAGE = 0.5
#: Characters of benchmark text that are broadcast at once.
BLOCK_CHARS = 8_000_000
#: Longest search length to begin with.
LONGEST = 64
PAIRS = "doc_id long, item_id long, item_words long, matched_words long, n_tiles long, coverage double"

WORD = re.compile(r"\w+")
BASE, PRIME = 1_000_003, (1 << 61) - 1


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def fingerprints(tokens: list[int], free: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """(place, Karp-Rabin fingerprint) of every stretch of that length without a mark."""
    top, h, run = pow(BASE, length - 1, PRIME), 0, 0
    for i, t in enumerate(tokens):
        if not free[i]:
            h = run = 0
            continue
        if run >= length:
            h = (h - tokens[i - length] * top) % PRIME
        h = (h * BASE + t) % PRIME
        run += 1
        if run >= length:
            yield i - length + 1, h


def tiling(item: list[int], doc: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, length) of the tiles; a token below 0 matches nothing."""
    free_a, free_b = [True] * len(item), [t >= 0 for t in doc]
    tiles: list[tuple[int, int, int]] = []
    search = max(least, min(LONGEST, len(item), len(doc)))
    while True:
        places = defaultdict(list)
        for i, h in fingerprints(item, free_a, search):
            places[h].append(i)
        found: dict[int, set[tuple[int, int]]] = defaultdict(set)
        longest = 0
        if places:
            for j, h in fingerprints(doc, free_b, search):
                for i in places.get(h, ()):
                    if i and j and free_a[i - 1] and free_b[j - 1] and item[i - 1] == doc[j - 1]:
                        continue  # it is part of the match that begins before
                    k = 0
                    while i + k < len(item) and j + k < len(doc) and free_a[i + k] and free_b[j + k] and item[i + k] == doc[j + k]:
                        k += 1
                    if k >= search:
                        found[k].add((i, j))
                        longest = max(longest, k)
        if longest > 2 * search:
            search = longest
            continue
        again = False
        for k in sorted(found, reverse=True):
            for i, j in sorted(found[k]):
                if all(free_a[i:i + k]) and all(free_b[j:j + k]):
                    free_a[i:i + k] = free_b[j:j + k] = [False] * k
                    tiles.append((i, j, k))
                else:
                    again = True  # what is left of it may still be long enough
        if again:
            continue
        if search <= least:
            return tiles
        search = max(least, search // 2)


class Seeds:
    """A block of items: their words' numbers and the fingerprints of their seeds."""

    def __init__(self, items: list[tuple[int, str]], coverage: float) -> None:
        self.coverage, self.vocabulary = coverage, {}
        self.items: list[tuple[int, list[int]]] = []
        #: By number of words: the fingerprints of items that are shorter than a seed, sorted, and whose they are.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        grams: list[np.ndarray] = []
        owners: list[int] = []
        brief: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            tokens = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if len(tokens) >= SEED:
                own = np.unique(self.grams(np.array(tokens, np.uint64)))
                grams.append(own)
                owners += [len(self.items)] * len(own)
                self.items.append((item_id, tokens))
            elif tokens:
                brief[len(tokens)].append((int(self.grams(np.array(tokens, np.uint64), len(tokens))[0]), len(self.items)))
                self.items.append((item_id, tokens))
        for n, pairs in brief.items():
            pairs.sort()
            self.short[n] = np.array([h for h, _ in pairs], np.uint64), np.array([k for _, k in pairs], np.int64)
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owners = flat[order], np.array(owners, np.int64)[order]

    @staticmethod
    def grams(tokens: np.ndarray, width: int = SEED) -> np.ndarray:
        n = len(tokens) - width + 1
        out = np.zeros(max(0, n), np.uint64)
        for k in range(width if n > 0 else 0):
            out = mixed(out + tokens[k:k + n])
        return out

    def whole(self, tokens: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """The items shorter than a seed that stand in the text."""
        for n, (fingers, owners) in self.short.items():
            own = self.grams(tokens, n)
            low, high = np.searchsorted(fingers, own), np.searchsorted(fingers, own, "right")
            found = set()
            for at in np.flatnonzero(high > low).tolist():
                for k in owners[low[at]:high[at]].tolist():
                    if k not in found and tokens[at:at + n].tolist() == self.items[k][1]:
                        found.add(k)
            for k in sorted(found):
                yield self.items[k][0], n, n, 1, 1.0

    def matches(self, text: str | None) -> Iterator[tuple[int, int, int, int, float]]:
        """(item_id, item words, matched words, tiles, coverage) of the items that the text contains."""
        number = self.vocabulary.get
        tokens = np.array([number(w, 0) for w in words(text)], np.uint64)
        yield from self.whole(tokens)
        if len(tokens) < SEED or not len(self.flat):
            return
        known = np.concatenate([[0], np.cumsum(tokens > 0)])
        starts = np.flatnonzero(known[SEED:] - known[:-SEED] == SEED)
        if not len(starts):
            return
        hashes = mixed(tokens[starts])
        for k in range(1, SEED):
            hashes = mixed(hashes + tokens[starts + k])
        low, high = np.searchsorted(self.flat, hashes), np.searchsorted(self.flat, hashes, "right")
        hit = np.flatnonzero(high > low)
        shared: dict[int, list[int]] = defaultdict(list)
        for s, a, b in zip(starts[hit].tolist(), low[hit].tolist(), high[hit].tolist()):
            for owner in self.owners[a:b].tolist():
                shared[owner].append(s)
        for owner, at in shared.items():
            item_id, item = self.items[owner]
            pieces: list[int] = []
            seen: dict[tuple, int] = defaultdict(int)
            begun = last = at[0]
            for s in [*at[1:], None]:
                if s is None or s > last + SEED:
                    piece = tokens[begun:last + SEED].astype(np.int64).tolist()
                    seen[tuple(piece)] += 1
                    if seen[tuple(piece)] <= -(-len(item) // SEED):  # no more equal stretches can be tiles
                        pieces += [-1, *piece]
                    begun = s
                last = s
            tiles = tiling(item, pieces)
            matched = sum(k for _, _, k in tiles)
            if matched >= self.coverage * len(item):
                yield item_id, len(item), matched, len(tiles), matched / len(item)


def blocks_of(spark: SparkSession, benchmark: DataFrame, coverage: float, block_chars: int) -> list:
    """Broadcasts of the benchmark's items, about so many characters each."""
    items = benchmark.select(column(benchmark, "item_id", "long").alias("item_id"), column(benchmark, "text", "string").alias("text")).where("text is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    out = []
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        pairs = sorted((-1 if r["item_id"] is None else r["item_id"], r["text"]) for r in own)
        out.append(spark.sparkContext.broadcast(Seeds(pairs, coverage)))
    return out


def contained(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The pairs of a document and an item that it contains."""
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    out = None
    for sent in blocks_of(docs.sparkSession, benchmark, coverage, block_chars):

        def run(batches: Iterator[pa.RecordBatch], sent=sent):
            names = [f.split()[0] for f in PAIRS.split(", ")]
            kinds = [pa.int64()] * 5 + [pa.float64()]
            for batch in slices(batches):
                found = [(doc, *m) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in sent.value.matches(text)]
                columns = zip(*found) if found else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        pairs = rows.mapInArrow(run, PAIRS)
        out = pairs if out is None else out.unionByName(pairs)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs that contain no item, in one pass for each block and without a shuffle; between passes they are written, so a task has one block's worker."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = docs.columns.index("text")
    for k, sent in enumerate(blocks_of(docs.sparkSession, benchmark, coverage, block_chars)):

        def run(batches: Iterator[pa.RecordBatch], sent=sent):
            for batch in slices(batches):
                yield batch.filter(pa.array([next(sent.value.matches(t), None) is None for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = (materialize(docs, "clean") if k else docs).mapInArrow(run, fields)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
