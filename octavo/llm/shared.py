"""What the corpus operators share: the shared folder, hashing, components."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_C = ctypes.CDLL(None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; on a single machine that names none, a folder of our own, removed at the end."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jsc.isDefined():
            return jsc.get()
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="octavo-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark)}/octavo-{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the tables that this application has materialized; results that read them must be written before."""
    delete(spark, scratch(spark))


_scopes: list[str] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, the tables that are materialized inside; results that read them must be written there too."""
    _scopes.append(uuid.uuid4().hex)
    try:
        yield
    finally:
        delete(spark, f"{scratch(spark)}/{_scopes.pop()}")


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Writes a table into the shared folder and reads it again.

    It cuts the lineage, and it survives the loss of executors.
    """
    path = "/".join([scratch(df.sparkSession), *_scopes[-1:], f"{label}-{uuid.uuid4().hex}"])
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(df: DataFrame, name: str, kind: str):
    """The column, or nulls of that type where the table lacks it."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def release() -> None:
    """Gives unused memory back to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of so many rows and about so many bytes, a longer row alone, which bounds what is held as Python objects at once."""
    release()  # what the worker's last task has left
    for batch in batches:
        step = max(1, min(rows, size * batch.num_rows // max(1, batch.nbytes)))
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            if step > 1 and part.nbytes > 2 * size:  # long rows side by side
                yield from (part.slice(j, 1) for j in range(part.num_rows))
            else:
                yield part
    release()


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: White space between words, and a value for each byte: that of a small letter for a capital, none for white space.
SPACES = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
CASED = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
CASED[SPACES] = 0
_VALUES = CASED.copy()
_VALUES[65:91] = _VALUES[97:123]
_FACTOR = 0x9E3779B97F4A7C15
#: Bytes whose words are hashed at once; a longer word alone.
_HASHED = 1 << 16


def _powers(factor: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n - 1, factor, np.uint64)))


_UP, _DOWN = _powers(_FACTOR, _HASHED), _powers(pow(_FACTOR, -1, 1 << 64), _HASHED)


def word_places(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes in a row, where words start and end there, and the number of the first word of each text but the first."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(coded), np.uint8)
    edges = np.flatnonzero(np.diff(~np.take(SPACES, data), prepend=False, append=False))
    bounds = np.cumsum([len(c) + 1 for c in coded[:-1]], dtype=np.int64)
    return data, edges[::2], edges[1::2], np.searchsorted(edges[::2], bounds)


def word_hashes(texts: list[str | None], cased: bool = False) -> list[np.ndarray]:
    """Per text, 64-bit hashes of its words (words_of): polynomials of the bytes' values, for all texts at once; cased: capitals count."""
    data, starts, ends, firsts = word_places(texts)
    table = CASED if cased else _VALUES
    out, low = np.empty(len(starts), np.uint64), 0
    while low < len(starts):
        at = int(starts[low])
        high = max(low + 1, int(np.searchsorted(ends, at + _HASHED, "right")))
        n = int(ends[high - 1]) - at
        values, own = np.take(table, data[at:at + n]), starts[low:high] - at
        values *= _UP[:n] if n <= len(_UP) else _powers(_FACTOR, n)
        # powers of a byte's place, taken back by the place of its word; white space adds nothing
        found = np.add.reduceat(values, own) * np.take(_DOWN, own)
        out[low:high] = mixed(found + (ends[low:high] - starts[low:high]).astype(np.uint64))
        low = high
    return np.split(out, firsts) if texts else []


def sequences(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every `width` words in a row; a shorter text counts as one."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(width, n)
    out = np.full(n - k + 1, k if n < width else 0, np.uint64)
    for j in range(k):
        out = mixed(out * np.uint64(0xBF58476D1CE4E5B9) + hashes[j:n - k + 1 + j])
    return out


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The distinct ones, sorted."""
    return np.unique(sequences(hashes, width))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for undirected edges (u, v): the smallest id reachable.

    Alternates large-star and small-star until nothing changes. A hub's
    neighbours are never gathered: its minimum is aggregated, and joined back from
    a table of its own, since Spark splits a hot key only of a join that shuffles.
    """
    edges = edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = materialize(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        large = materialize(large, "stars")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(low.select("u", F.col("m").alias("v")).unionByName(small).distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                        F.sum("v")).first()
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
