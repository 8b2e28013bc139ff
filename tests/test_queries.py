"""Every registered query of the metrics layer against its SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from meridian import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    found = duckdb.connect()
    found.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        found.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return found


def plain(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, tables, name):
    got = queries.QUERIES[name](spark, SF)
    want = tables.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(got.columns, [tuple(r) for r in got.collect()]) == plain(names, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
