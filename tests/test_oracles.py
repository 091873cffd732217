"""Every query that SQL can express, against DuckDB over the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from flowlens.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


def plain(value):
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return None if isinstance(value, float) and math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    expected = duck.sql(catalog.ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in found.collect()]
    at = [expected.columns.index(c) for c in columns]
    other = [tuple(plain(r[k]) for k in at) for r in expected.fetchall()]
    key = lambda r: tuple((v is None, str(type(v)), str(v)) for v in r)
    assert sorted(rows, key=key) == sorted(other, key=key)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
