"""Each query of the core with SQL against DuckDB on the smallest test tables, where these exist."""

import math
import os

import pytest

from orthostat import plans

DATA = "/root/testdata/sf0.001"
PAIRS = {name: (module.QUERIES[name], sql) for module in plans.modules() for name, sql in module.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", list(PAIRS))
def test_query(spark, duck, name):
    query, sql = PAIRS[name]
    df = query(spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(sql)
    assert sorted(want.columns) == columns
    rows = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    assert rows == sorted((tuple(map(plain, r)) for r in want.select(*(f'"{c}"' for c in columns)).fetchall()), key=repr)


def test_no_sql_without_query():
    for module in plans.modules():
        assert set(module.SQL) <= set(module.QUERIES)
