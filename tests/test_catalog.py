"""Every registered engine query against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import os

import pytest

from quillon.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(FOLDER):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral() else round(float(value), 6)
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    told = duck.execute(catalog.ORACLE_SQL[name])
    held = [c[0] for c in told.description]
    assert sorted(held) == names
    at = [held.index(c) for c in names]
    want = sorted((tuple(plain(row[i]) for i in at) for row in told.fetchall()), key=repr)
    got = sorted((tuple(plain(x) for x in row) for row in df.select(*[f"`{c}`" for c in names]).collect()), key=repr)
    assert got == want
