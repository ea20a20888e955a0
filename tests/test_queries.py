"""Every named query against its SQL in DuckDB, on the smallest tables."""

import os
from collections import Counter

import pytest

from reefline.plans.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def shown(v):
    if v is None or v != v:
        return None
    return round(float(v), 9) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = Counter(tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect())
    rel = duck.sql(SQL[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert sorted(rel.columns) == sorted(df.columns)
    want = Counter(tuple(shown(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in rel.fetchall())
    got = Counter({tuple(shown(float(v)) if v is not None and isinstance(v, str) and _numeric(v) and not isinstance(v, float) else v for v in k): n for k, n in got.items()})
    want = Counter({tuple(shown(float(v)) if v is not None and isinstance(v, str) and _numeric(v) else v for v in k): n for k, n in want.items()})
    assert got == want


def _numeric(v: str) -> bool:
    try:
        float(v)
    except ValueError:
        return False
    return v.replace(".", "", 1).replace("-", "", 1).isdigit()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


def test_queries_return_rows(spark):
    """A query without rows would equal any SQL without rows."""
    empty = [name for name, f in QUERIES.items() if f(spark, DATA).isEmpty()]
    assert not empty
