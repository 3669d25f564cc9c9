"""N-gram Jaccard join with adaptive prefixes that ask for several matches.

A document is the set of its word shingles. Under one order of all shingles,
two sets that overlap in at least t share at least t - (n - p) of the first p of
the one whose prefix ends first. A document's prefix is the shortest that finds
every partner by one shingle, and some more where its candidates are estimated
to cost more; a pair is verified only if it shares as many prefix shingles as
its two lengths and sizes ask for. And the first shingle that it shares must
stand early enough in both for the rest to suffice, which spares the pairs of
copies that are near, but not near enough.

The order puts frequent shingles last. Frequencies are counted over all
documents, in hashed counters of a fixed number; whatever the counters say, the
order is the same for all, so no pair is lost.

Equal sets (of one size and 128-bit digest) are one class. A group of near copies isn't expanded into its pairs:
first every class is compared with one pivot for each of its prefix shingles;
then those that still lie in different components and share a shingle. A link
inside a component can't change the components.

A document without words or text has an empty set and links with nothing. Rows
with one doc_id are one document, whose sets all count; a null doc_id links with
nothing. A text of any length is one set. Of documents that are linked the least
doc_id names the component, so ties can't arise. An empty table gives no rows.
Extra columns stay in ``representatives`` and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column, connected_components, materialize, sequences, shingles, slices, word_hashes

#: Counters of the shingles' frequencies, and bits of the filter on ids.
COUNTERS, ID_BITS = 1 << 20, 1 << 24
#: Shared prefix shingles that are asked for: from so many to so many, one more for each doubling of the cost.
LEAST, MOST, COST = 3, 8, 32
#: What makes a class.
CLASS = ["a", "b", "n"]
#: Classes that a task remembers, so as not to give their prefixes again.
SEEN = 50_000


def required(n: np.ndarray | int, percent: int):
    """Overlap that a set of n needs with any partner."""
    return -(-percent * n // 100)


def need_sql(percent: int) -> str:
    return f"(({percent} * n + 99) div 100)"


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))


def digest(s: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist())


def frequencies(docs: DataFrame, width: int) -> DataFrame:
    """(counter, n) of the counters that a task found frequent."""

    def run(batches: Iterator[pa.RecordBatch]):
        counters = np.zeros(COUNTERS, np.int64)
        for batch in slices(batches):
            found = [sequences(h, width) for h in word_hashes(batch.column(0).to_pylist())]
            np.add.at(counters, (np.concatenate(found) >> np.uint64(44)).astype(np.int64), 1)
        mean = counters.mean()
        frequent = np.flatnonzero(counters >= mean + 6 * mean ** 0.5 + 4)
        yield pa.RecordBatch.from_arrays([pa.array(frequent), pa.array(counters[frequent])], ["counter", "n"])

    return _ids(docs).select("text").mapInArrow(run, "counter long, n long")


def classified(docs: DataFrame, width: int, percent: int, often) -> DataFrame:
    """(doc_id, n, a, b, ell, prefix) of each row, a and b its class; the prefix is null where the task has met the class."""

    def run(batches: Iterator[pa.RecordBatch]):
        seen, counts = set(), often.value
        for batch in slices(batches):
            sizes, keys, ells, prefixes = [], [], [], []
            for h in word_hashes(batch.column(1).to_pylist()):
                s = shingles(h, width)
                n = len(s)
                key, ell, prefix = digest(s), 0, None
                if n and key not in seen:
                    if len(seen) < SEEN:
                        seen.add(key)
                    own = counts[(s >> np.uint64(44)).astype(np.int64)]
                    need = required(n, percent)
                    least = n - need + 1
                    light = np.flatnonzero(own == 0)
                    if len(light) < n and len(light) < least + MOST:
                        rest = np.flatnonzero(own)
                        light = np.concatenate([light, rest[np.argsort(own[rest], kind="stable")]])
                    cost = float(own[light[:least]].mean())
                    ell = min(MOST, need, LEAST + int(np.log2(1 + cost / COST)))
                    prefix = s[light[:least - 1 + ell]].view(np.int64)
                sizes.append(n)
                keys.append(key)
                ells.append(ell)
                prefixes.append(prefix)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), *(pa.array([k[x] for k in keys], pa.int64()) for x in (0, 1)), pa.array(ells, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))],
                ["doc_id", "n", "a", "b", "ell", "prefix"])

    return _ids(docs).mapInArrow(run, "doc_id long, n long, a long, b long, ell int, prefix array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, n, items) of the documents in wanted.

    A filter of fixed size on the ids goes first, so that most texts aren't
    read for nothing; the join after it is exact.
    """
    spot = F.pmod(F.xxhash64("id"), F.lit(ID_BITS))
    rows = wanted.select(spot.alias("spot")).selectExpr("int(spot div 64) AS word", "shiftleft(1L, int(spot % 64)) AS bit") \
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    array = np.zeros(ID_BITS // 64, np.uint64)
    array[rows["word"].to_numpy()] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(array)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            at = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            own = batch.filter(pa.array((sent.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))
            found = [shingles(h, width) for h in word_hashes(own.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["id", "n", "items"])

    texts = _ids(docs).where("doc_id is not null").withColumn("spot", F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS)))
    return texts.mapInArrow(run, "id long, n long, items binary").join(wanted, "id", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), max(0, len(y) - 1))
                same = int((y[at] == x).sum()) if len(x) else 0
                keep.append(same > 0 and 100 * same >= percent * (len(x) + len(y) - same))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    left = sets.select(F.col("id").alias("u"), F.col("items").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("items").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def links(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their class, the id of each class, and (node, component) of the ids that have links."""
    spark = docs.sparkSession
    often = np.zeros(COUNTERS, np.int64)
    counted = frequencies(docs, width).groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    often[counted["counter"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    rows = materialize(classified(docs, width, percent, spark.sparkContext.broadcast(often)), "classes")
    reps = rows.where("n > 0 and doc_id is not null").groupBy(*CLASS).agg(F.min("doc_id").alias("id"))

    # one prefix for each class; those that the tasks give again are dropped
    prefixes = rows.where("prefix is not null").select(*CLASS, "prefix").dropDuplicates(CLASS).join(reps, CLASS)
    prefixes = materialize(prefixes.select("id", "n", "prefix"), "prefixes")

    first_match = f"slice(prefix, 1, int(n - {need_sql(percent)} + 1))"
    post = prefixes.select("id", "n", F.posexplode(F.expr(first_match)).alias("pos", "token"))
    # aggregates are tables of their own, so that the joins shuffle and Spark may split a hot shingle
    many = materialize(post.groupBy("token").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("token"), "tokens")
    shared = materialize(post.join(many, "token"), "shared")

    # of the shingles that two sets share, the first in the order stands early enough in both
    overlap = f"(({percent} * (n + pn) + {99 + percent}) div {100 + percent})"
    early = f"least(n - pos, pn - ppos) >= {overlap}"

    def near(pairs: DataFrame) -> DataFrame:
        """The links among pairs that share as much of their prefixes as their sizes ask for."""
        left, right = (prefixes.select(F.col("id").alias(k), F.col("prefix").alias(f"p{k}")) for k in ("u", "v"))
        ready = pairs.distinct().join(left, "u").join(right, "v").where(
            f"size(array_intersect(pu, pv)) >= {overlap} - greatest(pn - size(pu), n - size(pv))").select("u", "v")
        ready = materialize(ready, "candidates")
        ids = ready.select(F.col("u").alias("id")).unionByName(ready.select(F.col("v").alias("id"))).distinct()
        return materialize(verified(ready, sets_of(docs, ids, width), percent), "near")

    first = shared.groupBy("token").agg(F.min(F.struct("pos", "id", "n")).alias("p")).select(
        "token", F.col("p.id").alias("u"), F.col("p.n").alias("pn"), F.col("p.pos").alias("ppos"))
    first = materialize(first, "pivots")
    star = shared.withColumnRenamed("id", "v").join(first, "token").where("u <> v").where(early)
    edges = near(star.select("u", "pn", "v", "n"))
    found = connected_components(edges)

    placed = materialize(shared.join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "token", "id", "n", "pos", F.coalesce("component", "id").alias("c")), "placed")
    several = placed.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("token")
    left = materialize(placed.join(materialize(several, "tokens"), "token"), "mixed")
    right = left.select("token", F.col("id").alias("u"), F.col("n").alias("pn"), F.col("pos").alias("ppos"), F.col("c").alias("pc"))
    rest = left.withColumnRenamed("id", "v").join(right, "token").where(f"u < v and c <> pc and {early}")
    rest = near(rest.select("u", "pn", "v", "n"))
    # links between components: few, and enough to join them
    across = rest.join(found.withColumnRenamed("node", "u"), "u", "left").withColumn("u", F.coalesce("component", "u")).drop("component") \
        .join(found.withColumnRenamed("node", "v"), "v", "left").withColumn("v", F.coalesce("component", "v")).drop("component")
    joined = connected_components(across)
    roots = found.join(joined.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left") \
        .select("node", F.coalesce("root", "component").alias("component"))
    alone = joined.join(found.select("node"), "node", "left_anti")
    return rows, reps, roots.unionByName(alone)


def components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    rows, reps, found = links(docs, width, percent)
    by_class = reps.join(found.withColumnRenamed("node", "id"), "id", "left").select(*CLASS, F.coalesce("component", "id").alias("c"))
    return rows.select("doc_id", *CLASS).join(by_class, CLASS, "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs, of each group the document with the smallest id; empty documents stay."""
    gone = components(docs, width, percent).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)


SQL = r"""
WITH RECURSIVE
w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS same FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM shared JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * same >= 90 * (a.n + b.n - same)),
reach(node, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT node, v FROM reach JOIN links ON u = r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(r) AS component_id FROM reach GROUP BY node) r USING (doc_id)"""
