"""The driver's entry points, and every engine query against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from rillframe.plans import ORACLES, QUERIES


def test_entry(spark, small):
    assert entry.entry(spark).count() == 3
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{small}/{name}.parquet')")
    return con


def plain(x):
    if x is None or x != x:
        return "null"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, small, db, name):
    got = QUERIES[name](spark, small)
    want = db.execute(ORACLES[name])
    columns = sorted(got.columns)
    names = [d[0] for d in want.description]
    assert columns == sorted(names)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())
    assert mine == theirs
