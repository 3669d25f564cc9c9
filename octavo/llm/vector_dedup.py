"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors of cosine c or more lie within a squared distance of 2 - 2c. They
are rotated and split into blocks of equal budget, so of a pair in reach at
least one block is within its share. Each block's range join is on a grid over
its first coordinates, of cells as wide as the block's reach: a vector is at
home in one cell and a guest in half of the neighbours. A candidate counts in
the first block whose budget it keeps, so that no pair counts twice, and is
verified by its cosine in double precision.

Equal vectors are one class with a multiplicity. A crowded cell is dealt into
chunks, and each pair of chunks is a task of bounded size; its pairs are counted
there and only a spanning forest of links leaves it.

Null and zero vectors and those with null or non-finite components link with
nothing, and so do vectors of different lengths. A vector may have any number of
components. Repeated rows are vectors of their own. A component is named by its
least vec_id, so there are no ties; equal vec_ids are one node. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column, connected_components, materialize, mixed, slices

COSINE = 0.95
BLOCKS, GRID = 8, 2
#: Vectors of a chunk; slack for rounding in distances; pairs verified at once.
CHUNK, SLACK, AT_ONCE = 8192, 1e-5, 40_000

_rotations: dict[int, np.ndarray] = {}


def rotation(dim: int) -> np.ndarray:
    if dim not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
        _rotations[dim] = q * np.sign(np.diag(r))
    return _rotations[dim]


def block_edges(dim: int) -> list[int]:
    n = min(BLOCKS, max(1, dim // GRID))
    return [dim * k // n for k in range(n + 1)]


def rotated(x: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated; rounded, so that they don't depend on the batch."""
    return np.round(x / np.linalg.norm(x, axis=1, keepdims=True) @ rotation(x.shape[1]), 7)


def parsed(df: DataFrame) -> DataFrame:
    """(vec_id, raw, a, b): the vector's bytes and their digest; nulls for one that links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            raws, first, second = [], [], []
            for v in batch.column(1).to_pylist():
                raw = None
                if v and None not in v:
                    x = np.array(v, np.float64)
                    if np.isfinite(x).all() and x.any():
                        raw = x.tobytes() if (x.astype(np.float32) != x).any() else x.astype(np.float32).tobytes() + b"f"
                a, b = np.frombuffer(xxhash.xxh3_128_digest(raw), np.int64).tolist() if raw else (None, None)
                raws.append(raw)
                first.append(a)
                second.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raws, pa.binary()), pa.array(first, pa.int64()), pa.array(second, pa.int64())], ["vec_id", "raw", "a", "b"])

    return df.select(column(df, "vec_id", "long").alias("vec_id"), column(df, "embedding", "array<double>").alias("v")).mapInArrow(
        run, "vec_id long, raw binary, a long, b long")


def vector(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[:-1], np.float32).astype(np.float64) if len(raw) % 4 else np.frombuffer(raw, np.float64)


def cells(classes: DataFrame, cosine: float) -> DataFrame:
    """(cell, home, block, id, many, raw): a class once for each block and cell that it visits."""
    total = 2 - 2 * cosine + SLACK

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            ids, many, raws = (c.to_pylist() for c in batch.columns)
            by_dim: dict[int, list[int]] = {}
            found = [vector(r) for r in raws]
            for k, x in enumerate(found):
                by_dim.setdefault(len(x), []).append(k)
            for dim, rows in by_dim.items():
                y, edges = rotated(np.stack([found[k] for k in rows])), block_edges(dim)
                width = (total / (len(edges) - 1)) ** 0.5 * 1.000001
                for block in range(len(edges) - 1):
                    axes = min(GRID, edges[block + 1] - edges[block])
                    at = np.floor(y[:, edges[block]:edges[block] + axes] / width).astype(np.int64)
                    steps = np.array(np.meshgrid(*[[-1, 0, 1]] * axes, indexing="ij")).reshape(axes, -1).T
                    steps = [s for s in steps.tolist() if s >= [0] * axes]  # half of them, and the cell itself
                    for s in steps:
                        key = np.full(len(rows), np.uint64(dim * 64 + block))
                        for j in range(axes):
                            key = mixed(key * np.uint64(31) + (at[:, j] + s[j]).view(np.uint64))
                        home = not any(s)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(key.view(np.int64)), pa.array(np.full(len(rows), home)), pa.array(np.full(len(rows), block, np.int32)),
                            pa.array([ids[k] for k in rows], pa.int64()), pa.array([many[k] for k in rows], pa.int64()), pa.array([raws[k] for k in rows], pa.binary())],
                            ["cell", "home", "block", "id", "many", "raw"])

    return classes.select("id", "many", "raw").mapInArrow(run, "cell long, home boolean, block int, id long, many long, raw binary")


def tasks(visits: DataFrame) -> DataFrame:
    """visits with the chunks that meet: kind 0 homes and guests, of which part 0 also meets itself; 1 homes with homes."""
    n = visits.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests")) \
        .where("homes > 0 and homes + guests > 1").select(
        "cell", F.ceil(F.col("homes") / CHUNK).cast("int").alias("h"), F.ceil(F.col("guests") / CHUNK).cast("int").alias("g"))
    n = materialize(n, "cells")  # so that the join shuffles and Spark may split a crowded cell
    mine = "int(pmod(xxhash64(id), IF(home, h, g)))"
    return visits.join(n, "cell").withColumn("mine", F.expr(mine)).withColumn("t", F.explode_outer(F.expr("""
        CASE WHEN home AND h = 1 THEN transform(sequence(0, greatest(g, 1) - 1), j -> struct(0 AS kind, 0 AS i, j AS j))
             WHEN home AND g = 0 THEN transform(sequence(0, h - 1), j -> struct(1 AS kind, least(mine, j) AS i, greatest(mine, j) AS j))
             WHEN home THEN concat(transform(sequence(0, h - 1), j -> struct(1 AS kind, least(mine, j) AS i, greatest(mine, j) AS j)),
                                   transform(sequence(0, g - 1), j -> struct(2 AS kind, mine AS i, j AS j)))
             WHEN h = 1 THEN array(struct(0 AS kind, 0 AS i, mine AS j))
             ELSE transform(sequence(0, h - 1), i -> struct(2 AS kind, i AS i, mine AS j)) END"""))).select(
        "cell", "t.kind", "t.i", "t.j", "home", "mine", "block", "id", "many", "raw").repartition("cell", "kind", "i", "j")


def compared(cosine: float):
    """The function of one task: (u, null, vectors linked) and (u, v, 0) of a spanning forest."""
    total = 2 - 2 * cosine + SLACK

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kind, i, j, block = (int(rows[c].iloc[0]) for c in ("kind", "i", "j", "block"))
        ids, many, home, mine = (rows[c].to_numpy() for c in ("id", "many", "home", "mine"))
        x = np.stack([vector(r) for r in rows["raw"]])
        y, edges = rotated(x), block_edges(x.shape[1])
        norms, budget = np.linalg.norm(x, axis=1), total / (len(edges) - 1)
        own = y[:, edges[block]:edges[block + 1]]
        # one product gives squared distances: (v, |v|^2, 1) by (-2 w, 1, |w|^2); it only preselects
        square, ones = (own * own).sum(1, keepdims=True), np.ones((len(own), 1))
        first, second = (np.hstack(m).astype(np.float32) for m in ((own, square, ones), (-2 * own, ones, square)))
        # a further coordinate is swept in order, as one more axis of the grid
        sweep, reach = own[:, min(GRID, own.shape[1] - 1)], budget ** 0.5 + 1e-6
        if kind == 1:
            parts = [(np.flatnonzero(mine == i), np.flatnonzero(mine == j), i == j)]
        else:
            h, g = np.flatnonzero(home), np.flatnonzero(~home)
            parts = [(h, g, False)] + ([(h, h, True)] if kind == 0 and j == 0 else [])
        linked, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for left, right, same in parts:
            left, right = (k[np.argsort(sweep[k], kind="stable")] for k in (left, right))
            for k in range(0, len(left), 256):
                a = left[k:k + 256]
                low = k if same else np.searchsorted(sweep[right], sweep[a[0]] - reach)
                b = right[low:np.searchsorted(sweep[right], sweep[a[-1]] + reach, "right")]
                p, q = np.nonzero(first[a] @ second[b].T <= np.float32(budget + 1e-4))
                if same:
                    p, q = p[p < q], q[p < q]
                p, q = a[p], b[q]
                for s in range(0, len(p), AT_ONCE):
                    u, v = p[s:s + AT_ONCE], q[s:s + AT_ONCE]
                    shares = np.add.reduceat((y[u] - y[v]) ** 2, edges[:-1], axis=1) <= budget
                    here = shares[:, block] & ~shares[:, :block].any(1)
                    u, v = u[here], v[here]
                    ok = np.einsum("ij,ij->i", x[u], x[v]) / (norms[u] * norms[v]) >= cosine
                    u, v = u[ok], v[ok]
                    np.add.at(linked, u, many[v])
                    np.add.at(linked, v, many[u])
                    while len(u):  # the least label of a component, pair by pair until nothing falls
                        least = np.minimum(labels[u], labels[v])
                        before = labels.copy()
                        np.minimum.at(labels, labels[u], least)
                        np.minimum.at(labels, labels[v], least)
                        labels = labels[labels]
                        if (labels == before).all():
                            break
        some, tree = np.flatnonzero(linked), np.flatnonzero(labels != np.arange(len(ids)))
        return pd.DataFrame({
            "u": np.concatenate([ids[some], ids[tree]]), "v": pd.array([None] * len(some) + ids[labels[tree]].tolist(), "Int64"),
            "n": np.concatenate([linked[some], np.zeros(len(tree), np.int64)])})

    return run


def near_vectors(df: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    rows = materialize(parsed(df), "vectors")
    classes = rows.where("raw is not null and vec_id is not null").groupBy("a", "b").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("many"), F.first("raw").alias("raw"))
    classes = materialize(classes, "classes")
    found = materialize(tasks(cells(classes, cosine)).groupBy("cell", "kind", "i", "j").applyInPandas(
        compared(cosine), "u long, v long, n long"), "pairs")
    counts = found.where("v is null").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("v is not null").select("u", "v")).withColumnRenamed("node", "id")
    by_class = classes.select("a", "b", "id", "many").join(counts, "id", "left").join(parts, "id", "left").select(
        "a", "b", (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("c"))
    return rows.select("vec_id", "a", "b").join(by_class, ["a", "b"], "left").select(
        "vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = f"""
WITH RECURSIVE
v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= {COSINE} ELSE false END),
reach(node, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT node, v FROM reach JOIN links ON u = r),
c AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON u = vec_id"""
