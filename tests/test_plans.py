"""Facts are read once for a request, whatever is asked of its rows."""

import re

import pytest

from meridian import queries

SF = "/root/testdata/sf0.001"


def scans(df, table: str) -> int:
    """Reads of a table's file in the plan that ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len(re.findall(rf"Scan parquet[^\n]*{table}\.parquet", plan))


@pytest.mark.parametrize("name", ["q_top_intersect", "q_percent_of_within", "q_top_of_within", "q_top_of", "q_percent_top", "q_sum", "q_windows", "q_total", "q_percent_within", "q_filters_reach_totals"])
def test_facts_are_read_once(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    assert scans(queries.project(spark, SF).ql(queries.REQUESTS[name][0]).df(), "lineitem") == 1
