"""Every registered query of the library runs on the smallest data; those with SQL give what DuckDB gives."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from tracewell import registry

SQL = registry.oracle_sql()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, sf, name):
    df = registry.queries()[name](spark, sf)
    got = [[plain(v) for v in r] for r in df.collect()]
    if name not in SQL:
        return
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert sorted(map(repr, got)) == sorted(repr([plain(r[i]) for i in order]) for r in want)
