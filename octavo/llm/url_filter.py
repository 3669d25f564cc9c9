"""URL filter: ordered host and path rules, then a Bloom filter cascade.

The cascade encodes a list of domains over the complete universe of keys that
the corpus's hosts can ask for. Level 1 holds the listed keys; level 2 the
unlisted keys that level 1 takes by mistake; level 3 the listed keys that
level 2 takes by mistake, and so on until no key of the universe is wrong. So
membership is exact for every url of the corpus, and rows are judged without a
join. Keys are dealt by hash into as many cascades as a bound on the bytes asks
for; each is broadcast alone and passed over the rows.

Null urls, urls without ``://`` and empty urls have an empty host and path; no
rule fits and no key is listed, so they are allowed. Of a long host all parent
domains count that aren't longer than the longest listed domain. Of rules that
fit and are equally long, the one that stands last in the rules counts. Repeated rows are judged
each. Empty tables give no rows, and an empty list blocks nothing. Extra columns
are ignored by the query and kept by ``judge``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column, materialize, mixed

#: Fixed values: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The listed domains, six families of advertising and junk; a domain stands for its subdomains too.
LISTED = tuple(f"{name}.example.{top}" for name in ("ads-track", "spam-farm", "casino-win", "free-bets", "cheap-pills", "adult-x") for top in ("com", "net", "org"))
FALSE_RATE_BITS = 6
#: Bytes of filter that are broadcast at once.
BROADCAST_BYTES = 32 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for say, at, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        rule, verdict = F.when(fits, at + prefix).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def suffixes(host: Column, longest: int) -> Column:
    """The host and its parent domains, but those longer than ``longest``, which can't be listed."""
    cut = F.length(host) > longest
    parts = F.split(F.when(cut, F.substring(host, F.length(host) - longest, F.lit(longest + 1))).otherwise(host), r"\.")
    n = F.size(parts) - F.when(cut, 1).otherwise(0)  # the first part of a cut host isn't whole, or is empty
    return F.when((host == "") | (n < 1), F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), ".")))


def two_hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


class Cascade:
    """Levels of (bit array, number of probes)."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, int]] = []

    @staticmethod
    def places(a: np.ndarray, b: np.ndarray, level: int, bits: int, probes: int) -> np.ndarray:
        """Bit numbers, one row for each key."""
        x, y = mixed(a ^ np.uint64(level * 0x51ED2701)), mixed(b + np.uint64(level)) | np.uint64(1)
        return (x[:, None] + np.arange(probes, dtype=np.uint64)[None] * y[:, None]) % np.uint64(bits)

    def hits(self, a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
        words, probes = self.levels[level]
        at = self.places(a, b, level, 64 * len(words), probes)
        return ((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(1).astype(bool)

    def contains(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether keys of the universe are listed: the levels in a row that take them are odd in number."""
        out, live = np.zeros(len(a), bool), np.arange(len(a))
        for level in range(len(self.levels)):
            live = live[self.hits(a[live], b[live], level)]
            out[live] = level % 2 == 0
        return out

    @property
    def nbytes(self) -> int:
        return sum(w.nbytes for w, _ in self.levels)


def dealt(universe: DataFrame, most_bytes: int) -> int:
    """Cascades that hold the keys within so many bytes each: the listed, and the others' false positives."""
    found = universe.agg(F.count_if("listed").alias("listed"), F.count("*").alias("all")).first()
    keys = found["listed"] + found["all"] / (1 << FALSE_RATE_BITS)
    return max(1, -(-int(keys * FALSE_RATE_BITS * 1.4427 * 1.1 / 8) // most_bytes))


def part_of(a: Column, parts: int) -> Column:
    return F.pmod(F.shiftrightunsigned(a, 40), F.lit(parts))


def build(universe: DataFrame) -> Cascade:
    """The cascade for (a, b, listed).

    Each level is built where its keys are: every task sets bits of its own and
    the words of all are or-ed. What comes to the driver is the filter itself.
    """
    cascade = Cascade()
    sides = [universe.where("listed"), universe.where("not listed")]
    while True:
        level = len(cascade.levels)
        members, others = sides[level % 2], sides[1 - level % 2]
        n = members.count()
        if not n:
            return cascade
        if level == 99:
            raise RuntimeError("keys with equal hashes are listed and unlisted")
        words = max(1, -(-int(n * FALSE_RATE_BITS * 1.4427) // 64))
        probes = FALSE_RATE_BITS

        def partial(batches: Iterator[pa.RecordBatch], level=level, words=words, probes=probes):
            for batch in batches:
                a, b = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
                at = np.unique(Cascade.places(a, b, level, 64 * words, probes))
                word, first = np.unique(at >> np.uint64(6), return_index=True)
                bits = np.left_shift(np.uint64(1), at & np.uint64(63))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word.astype(np.int64)), pa.array(np.bitwise_or.reduceat(bits, first).view(np.int64) if len(at) else bits.view(np.int64))], ["word", "bits"])

        rows = members.select("a", "b").mapInArrow(partial, "word long, bits long").groupBy("word").agg(
            F.bit_or("bits").alias("bits")).toPandas()
        array = np.zeros(words, np.uint64)
        array[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
        cascade.levels.append((array, probes))

        def wrong(batches: Iterator[pa.RecordBatch], cascade=cascade, level=level):
            for batch in batches:
                a, b = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
                yield batch.filter(pa.array(cascade.hits(a, b, level)))

        sides[1 - level % 2] = materialize(others.mapInArrow(wrong, others.schema), "wrong")


def membership(sent):
    """A function of the two hashes of a row's keys: whether the broadcast cascade lists one."""

    @F.pandas_udf("boolean")
    def in_list(first: pd.Series, second: pd.Series) -> pd.Series:
        counts = first.str.len().to_numpy()
        owner = np.repeat(np.arange(len(first)), counts)
        flat = [np.concatenate([np.asarray(v, np.int64) for v in s] or [np.zeros(0, np.int64)]).view(np.uint64) for s in (first, second)]
        hit = sent.value.contains(*flat)
        return pd.Series(np.bincount(owner[hit], minlength=len(first)) > 0)

    return in_list


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Adds host, path, rule and verdict to pages with a ``url``.

    ``listed`` has the blocked domains in ``key``.
    """
    host, path = host_and_path(column(pages, "url", "string"))
    rows = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    marked = listed.select(F.translate("key", UPPER, LOWER).alias("key")).where("key <> ''").distinct().withColumn("listed", F.lit(True))
    longest = marked.agg(F.coalesce(F.max(F.length("key")), F.lit(0))).first()[0]
    keys = rows.select("host").distinct().select(F.explode(suffixes(F.col("host"), longest)).alias("key")).distinct()
    a, b = two_hashes(F.col("key"))
    universe = materialize(keys.join(marked, "key", "left").select(
        a.alias("a"), b.alias("b"), F.coalesce("listed", F.lit(False)).alias("listed")), "keys")
    parts = dealt(universe, most_bytes)
    own = suffixes(F.col("host"), longest)
    found = rows.withColumn("__listed", F.lit(False))
    for part in range(parts):
        sent = pages.sparkSession.sparkContext.broadcast(build(universe.where(part_of(F.col("a"), parts) == part) if parts > 1 else universe))

        in_list = membership(sent)
        # a cascade answers for its own keys only
        mine = F.filter(own, lambda k: part_of(two_hashes(k)[0], parts) == part) if parts > 1 else own
        found = found.withColumn("__listed", F.col("__listed") | in_list(
            F.transform(mine, lambda k: two_hashes(k)[0]), F.transform(mine, lambda k: two_hashes(k)[1])))
        if part + 1 < parts:
            found = materialize(found, "judged")  # so that a task holds one cascade
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return found.withColumns({"rule": rule, "verdict": F.coalesce(
        verdict, F.when(F.col("__listed"), "block").otherwise("allow"))}).drop("__listed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = spark.createDataFrame([(k,) for k in LISTED], "key string")
    return judge(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    bad = " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in LISTED)
    return f"""
WITH rest AS (
  SELECT row_number() OVER () AS n, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
  FROM pages),
parts AS (
  SELECT n, page_id, regexp_extract(r, '^[^/?#]*') AS h,
         regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
p AS (SELECT n, page_id, translate(h, '{UPPER}', '{LOWER}') AS host, path FROM parts),
rules(verdict, rhost, rpath) AS (VALUES {rules}),
fit AS (
  SELECT n, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC) AS k
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN {bad} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (n)"""


SQL = _sql()
