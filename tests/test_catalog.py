"""Every catalogue query against its DuckDB twin on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from octavo.functions.constants import SIZED
from octavo.plans import catalog

from .conftest import SF

WITH_SQL = [n for n, q in catalog.QUERIES.items() if q.sql]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def text(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return "~"
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return str(bool(v))
    try:
        return repr(float(v))
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(map(tuple, df[columns].map(text).to_numpy().tolist()))


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_its_oracle(spark, duck, name):
    q = catalog.QUERIES[name]
    assert rows(q.plan(spark, SF).toPandas()) == rows(duck.execute(q.sql).df())


@pytest.mark.parametrize("name", [n for n, q in catalog.QUERIES.items() if not q.sql])
def test_query_without_oracle_has_rows(spark, name):
    assert catalog.QUERIES[name].plan(spark, SF).count() > 0


def test_all_round_trips_are_exact(spark):
    for r in catalog.QUERIES["roundtrip_all"].plan(spark, SF).collect():
        assert r.encoded == r.exact


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def no_close_lines(tmp_path_factory):
    """Documents whose lines of a page hold one word each, or are raw or zero: the base-delta codec is the best for the first
    ones, and no line in any batch has small deltas; some owners have several clusters."""
    folder = tmp_path_factory.mktemp("no_close_lines")
    lines = ["".join(chr(33 + (k * 7919 + doc * 104729 + j * j * 31) % 90) for j in range(8)) * 8 for doc in range(6) for k in range(400)]
    texts = ["".join(lines[doc * 400:doc * 400 + n]) for doc, n in enumerate((1, 64, 70, 130, 400))]
    texts += ["".join(chr(33 + (k * k * 31 + k * 17) % 90) for k in range(9000)), "", None, "".join(lines) * 8]
    docs = pd.DataFrame({"doc_id": range(1, len(texts) + 1), "text": texts, "lang": "en", "source": "made", "n_chars": [len(x or "") for x in texts]})
    docs.to_parquet(folder / "documents.parquet")
    os.symlink(f"{SF}/events.parquet", folder / "events.parquet")
    con = duckdb.connect()
    for f in ("documents", "events"):
        con.execute(f"CREATE VIEW {f} AS SELECT * FROM '{folder}/{f}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", [
    "cluster_decompress", "drain_restore", "fault_restore", "store_bytes", "parallel_stats", "store_upsert", "roundtrip_sized",
])
def test_pages_without_close_lines(spark, no_close_lines, name):
    folder, con = no_close_lines
    got = catalog.QUERIES[name].plan(spark, folder).toPandas()
    assert rows(got) == rows(con.execute(catalog.QUERIES[name].sql).df()) and len(got)


def test_all_round_trips_without_close_lines(spark, no_close_lines):
    folder, con = no_close_lines
    got = catalog.QUERIES["roundtrip_all"].plan(spark, folder).toPandas()
    assert len(got) == 10 and (got.encoded == got.exact).all()
    assert rows(got[got.codec.isin(SIZED)]) == rows(con.execute(catalog.QUERIES["roundtrip_sized"].sql).df())
