"""A keyed page store as immutable snapshots: admit, look up, remove, drain, clusters.

Keys are (owner_id, page_index), so that owners with equal addresses don't meet.
An entry holds the codec's id, the code's length and, in a store of bytes, the code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import CLUSTER, SIZED
from . import codes, stats

KEY = ["owner_id", "page_index"]


def snapshot(best: DataFrame, owner: str, index: str) -> DataFrame:
    """(owner_id, page_index, algo_id, compressed_len) of the pages worth storing."""
    return best.select(F.col(owner).cast("bigint").alias("owner_id"), F.col(index).cast("bigint").alias("page_index"),
                       F.col("best_algo").alias("algo_id"), F.col("best_size").alias("compressed_len"))


def compress_and_store(pages: DataFrame, owner: str, index: str, codecs=SIZED, most: int = 0) -> DataFrame:
    """The entries with their codes, of the pages worth storing, in one pass; at most ``most`` by key, 0 is no limit."""
    rows = pages.select(F.col(owner).cast("bigint").alias("owner_id"), F.col(index).cast("bigint").alias("page_index"), "page")
    return admit(codes.stored(rows, codecs), most)


def fault_restore(faults: DataFrame, store: DataFrame) -> DataFrame:
    """The faults with ``page`` and ``status``: decoded where an entry is stored, else missing."""
    return codes.restored(faults.join(store, KEY, "left"))


def drain_restore(store: DataFrame, n: int) -> DataFrame:
    """The pages of the first n entries by key."""
    return codes.restored(drain(store, n))


def compress_and_replace(versions: DataFrame, codecs=SIZED) -> DataFrame:
    """The store after pages were written again and again: (owner_id, page_index, version, page).

    A version that isn't worth storing leaves the entry as it was. All versions
    are coded in one pass, and the latest entry of a key stays.
    """
    return latest(codes.stored(versions, codecs))


def latest(entries: DataFrame) -> DataFrame:
    """Of each key the entry with the greatest version, without it."""
    rest = [c for c in entries.columns if c not in (*KEY, "version")]
    return entries.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "version").alias("e")).select(*KEY, "e.*")


def cluster_restore(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """(owner_id, cluster, items, failed, first_error, bytes, pages_md5): clusters of up to 32 neighbours, decoded.

    ``wanted`` has the keys. Entries that aren't stored fail with -2, and codes that can't be decoded with -22.
    """
    got = codes.restored(wanted.select(*KEY).distinct().join(store, KEY, "left")).withColumns(
        {"cluster": F.expr(f"page_index div {CLUSTER}"), "place": F.col("page_index"), "md5": F.md5(F.hex("page"))})
    errors = stats.first_errors(got, "owner_id", "cluster")
    pages = got.groupBy("owner_id", "cluster").agg(
        F.coalesce(F.sum("compressed_len"), F.lit(0)).alias("bytes"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == 0, F.struct("place", "md5")))), lambda x: x["md5"]), "")).alias("pages_md5"))
    return errors.join(pages, ["owner_id", "cluster"])


def upsert(store: DataFrame, entries: DataFrame) -> DataFrame:
    """New entries replace old ones of their key."""
    return store.join(entries.select(KEY), KEY, "left_anti").unionByName(entries)


def lookup(faults: DataFrame, store: DataFrame) -> DataFrame:
    return faults.join(store, KEY)


def misses(faults: DataFrame, store: DataFrame) -> DataFrame:
    return faults.join(store.select(KEY), KEY, "left_anti")


def is_stored(pages: DataFrame, store: DataFrame) -> DataFrame:
    return pages.join(store.select(KEY), KEY, "left_semi")


def remove(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select(KEY), KEY, "left_anti")


def zap_owners(store: DataFrame, exited: DataFrame) -> DataFrame:
    return store.join(exited.select("owner_id"), "owner_id", "left_anti")


def zap_range(store: DataFrame, owner: int, first: int, last: int) -> DataFrame:
    """Without an owner's pages of a range of addresses."""
    return store.where(~((F.col("owner_id") == owner) & F.col("page_index").between(first, last)))


def zap_ranges(store: DataFrame, ranges: DataFrame) -> DataFrame:
    """Without the pages that a row (owner_id, first, last) of ranges names."""
    r = ranges.select(F.col("owner_id").alias("__owner"), "first", "last")
    return store.join(r, (F.col("owner_id") == F.col("__owner")) & F.col("page_index").between(F.col("first"), F.col("last")), "left_anti")


def drain(store: DataFrame, n: int) -> DataFrame:
    """The first n entries by key."""
    return store.orderBy(*KEY).limit(n)


def admit(entries: DataFrame, most: int) -> DataFrame:
    """The first entries by key that a pool of ``most`` pages takes; 0 is no limit."""
    return entries if most <= 0 else entries.orderBy(*KEY).limit(most)


def restored(faults: DataFrame, store: DataFrame) -> DataFrame:
    """How many markers found their entry."""
    return faults.join(store, KEY, "left").agg(
        F.count("*").alias("markers"), F.count("algo_id").alias("restored"), F.count_if(F.col("algo_id").isNull()).alias("failed"))
