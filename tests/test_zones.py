"""Times have no zone: clock changes of the session's zone change nothing."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from meridian.functions.expressions import boundaries, column_of, part_of, truncated
from meridian.plans.syntax import call, literal

# 2024-03-10 02:30 doesn't exist in New York, and 01:30 on 2024-11-03 is there twice.
TIMES = ["2024-03-10 01:30:00", "2024-03-10 02:30:59.5", "2024-03-10 04:30:00", "2024-11-03 00:59:59", "2024-11-03 01:30:00", "2024-11-03 03:00:00", "1969-12-31 23:59:59", "1883-11-18 12:03:57"]


@pytest.fixture(params=["UTC", "America/New_York", "Asia/Kolkata"])
def times(request, spark):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield spark.createDataFrame([(t,) for t in TIMES], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_truncation(times):
    change = {"day": {"hour": 0, "minute": 0, "second": 0}, "hour": {"minute": 0, "second": 0}, "minute": {"second": 0}, "second": {}}
    change["month"] = change["day"] | {"day": 1}
    change["year"] = change["month"] | {"month": 1}
    for part, fields in change.items():
        for r in times.select("t", truncated(part, F.col("t")).alias("x")).collect():
            assert r.x == r.t.replace(microsecond=0, **fields)
    assert [r.x.weekday() for r in times.select(truncated("week", F.col("t")).alias("x")).collect()] == [0] * len(TIMES)


def test_differences(times):
    both = times.crossJoin(times.withColumnRenamed("t", "u"))
    each = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}
    start = datetime(1800, 1, 1)
    for part, seconds in each.items():
        for r in both.select("t", "u", boundaries(part, F.col("t"), F.col("u")).alias("n")).collect():
            at = lambda v: int((v.replace(microsecond=0) - start).total_seconds()) // seconds  # noqa: B023, E731
            assert r.n == at(r.u) - at(r.t)
    assert [r.h for r in times.select(part_of("hour", F.col("t")).alias("h")).collect()] == [1, 2, 4, 0, 1, 3, 23, 12]


def test_floor_division_of_whole_numbers_is_exact(spark):
    big = 2**53 + 1
    cases = [(big, 1), (-big, 2), (big * 3, 3), (7, -2), (-7, -2), (6, -3), (5, 0), (None, 2)]
    df = spark.createDataFrame(cases, "a long, b long")
    got = [r.q for r in df.select(column_of(call("floordiv", literal(1), literal(1)), lambda n: None).alias("one"), "a", "b", _floor("a", "b").alias("q")).collect()]
    assert got == [None if a is None or not b else a // b for a, b in cases]
    assert [r.q for r in spark.createDataFrame([(7.5, 2.0), (-7.5, 2.0), (1.0, 0.0)], "a double, b double").select(_floor("a", "b").alias("q")).collect()] == [3, -4, None]


def _floor(a: str, b: str):
    from meridian.plans.syntax import Node

    return column_of(call("floordiv", Node("column", (a,)), Node("column", (b,))), lambda n: F.col(n.value[-1]))
