"""Queries with SQL: DuckDB gives the same rows, also for nulls, empty and long texts, repeated rows and empty tables."""

from collections import Counter

import duckdb
import pytest

from meridian.llm import queries

SF = "/root/testdata/sf0.001"


def compared(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet{'' if folder == SF else '/*.parquet'}'")
    found = con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    got = queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(found.fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    compared(spark, name, SF)


@pytest.mark.parametrize("rows", ["odd", "none"])
@pytest.mark.parametrize("name", sorted(set(queries.ORACLES) - {"op6_line_dedup"}))  # its SQL knows documents by id
def test_sql_on_odd_rows(spark, request, tmp_path, name, rows):
    request.getfixturevalue(rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w9 w10"), (2, "one two three"), (2, "one two three"), (3, None), (4, ""), (None, "two three")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    compared(spark, name, str(tmp_path))
