"""Every registered query with SQL against DuckDB on the smallest tables; the others by their rows."""

import math
import os

import duckdb
import pytest

from tidemark import catalog

DATA = os.environ.get("TIDEMARK_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool, int)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return plain(float(v)) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    rows = [r.asDict(recursive=True) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    assert rows
    if sql is None:
        return
    found = duck.sql(sql)
    names = sorted(found.columns)
    assert sorted(df.columns) == names
    want = [dict(zip(found.columns, r)) for r in found.fetchall()]
    key = lambda rs: sorted((tuple(plain(r[c]) for c in names) for r in rs), key=repr)
    assert key(rows) == key(want)


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
