"""Every catalogue query against its SQL in DuckDB on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from kalmia.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(value):
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return value


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, (int, float)) and abs(a - b) < 2e-5)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    rows = [tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()]
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(got.columns)
    names = sorted(want.columns)
    right = [tuple(plain(v) for v in r) for r in want.project(", ".join(f'"{c}"' for c in names)).fetchall()]
    key = lambda r: [(v is None, str(v)) for v in r]
    assert len(rows) == len(right)
    for x, y in zip(sorted(rows, key=key), sorted(right, key=key), strict=True):
        assert all(same(p, q) for p, q in zip(x, y, strict=True)), (x, y)
