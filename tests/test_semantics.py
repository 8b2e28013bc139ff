"""What requests mean, on small frames with nulls, ties and rows without partners."""

import datetime as dt

import pytest

from meridian import errors as e
from meridian.functions.expressions import column_of
from meridian.plans.syntax import parse
from meridian.project import Project
from meridian.sources.tables import Catalog

MODEL = {
    "tables": {
        "sales": {
            "source": "sales", "related": {"item": {"table": "items", "foreign_key": "item_id"}, "clerk": {"table": "staff", "foreign_key": "clerk_id"}},
            "dimensions": {"shop": {"type": "str", "expr": "shop"}, "day": {"type": "date", "expr": "day"}, "size": {"type": "int", "expr": "size"}},
            "measures": {
                "amount": {"expr": "sum(value)", "time": "day"}, "filled": {"expr": "sum(value)", "missing": 0}, "n": {"expr": "count()", "type": "int"}, "big": {"expr": "count()", "type": "int", "filter": "value > 5"},
                "kinds": {"expr": "countd(item.kind)", "type": "int"}, "mean": {"expr": "$amount / $n"},
            },
        },
        "items": {"source": "items", "primary_key": "id", "dimensions": {"kind": {"type": "str", "expr": "kind"}, "item_amount": {"type": "float", "expr": "$amount"}, "item_big": {"type": "int", "expr": "$big"}}, "measures": {"n_items": {"expr": "count()", "type": "int"}}},
        "staff": {
            "source": "staff", "primary_key": "id", "related": {"boss": {"table": "staff", "foreign_key": "boss_id"}},
            "dimensions": {"clerk_name": {"type": "str", "expr": "name"}, "boss_name": {"type": "str", "expr": "boss.name", "missing": "nobody"}, "grand_boss": {"type": "str", "expr": "boss.boss.name"}, "team": {"type": "int", "expr": "$headcount"}},
            "measures": {"headcount": {"expr": "count()", "type": "int"}},
        },
    },
    "metrics": {"per_item": {"expr": "$amount / $n_items"}, "by_big": {"expr": "$amount / $big"}, "either": {"expr": "case when $n > 2 then 1 else 0 end", "type": "int"}},
}


@pytest.fixture(scope="module")
def project(spark):
    day = lambda d: dt.datetime(2021, 12, d)
    sales = [("x", 1, 1, 10.0, day(19), 3), ("x", 2, 2, 2.0, day(20), 7), (None, 1, 2, 4.0, day(20), 12), ("y", None, None, 8.0, None, None), ("y", 3, 9, 8.0, day(31), 12), (None, 4, 1, None, day(1), 1)]
    frames = {
        "sales": spark.createDataFrame(sales, "shop string, item_id int, clerk_id int, value double, day timestamp_ntz, size int"),
        "items": spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (5, "unsold")], "ID int, Kind string"),
        "staff": spark.createDataFrame([(1, "Ann", None), (2, "Bob", 1), (3, "Cyd", 2)], "id int, name string, boss_id int"),
    }
    return Project(spark, MODEL, Catalog(spark, frames=frames))


def got(project, text):
    return [tuple(r) for r in project.ql(text).df().collect()]


def test_null_dimensions_are_a_group_of_their_own(project):
    assert got(project, "select amount, n by shop") == [(None, 4.0, 2), ("x", 12.0, 2), ("y", 16.0, 2)]


def test_drill_across_keeps_what_only_one_side_has(project):
    assert got(project, "select filled, n_items by kind") == [(None, 16.0, 1), ("a", 14.0, 1), ("b", 2.0, 1), ("unsold", 0.0, 1)]
    assert got(project, "select amount, per_item by kind") == [(None, 16.0, 16.0), ("a", 14.0, 14.0), ("b", 2.0, 2.0), ("unsold", None, None)]


def test_a_filtered_measure_is_null_where_no_row_passes(project):
    assert got(project, "select n, big by shop") == [(None, 2, None), ("x", 2, 1), ("y", 2, 2)]
    assert got(project, "select big by shop") == [("x", 1), ("y", 2)]
    assert got(project, "select big where shop = 'none'") == [(0,)]
    assert got(project, "select by_big by shop") == [(None, None), ("x", 12.0), ("y", 8.0)]


def test_self_join_and_missing_values(project):
    assert got(project, "select amount by clerk_name, boss_name, grand_boss") == [(None, "nobody", None, 16.0), ("Ann", "nobody", None, 10.0), ("Bob", "Ann", None, 6.0)]
    assert got(project, "select headcount by grand_boss") == [(None, 2), ("Ann", 1)]
    assert got(project, "select headcount by team") == [(1, 3)]


def test_aggregate_dimensions(project):
    assert got(project, "select n by item_amount") == [(None, 2), (2.0, 1), (8.0, 1), (14.0, 2)]
    assert got(project, "select n_items by item_amount, item_big") == [(None, None, 1), (2.0, None, 1), (8.0, 1, 1), (14.0, 1, 1)]
    assert got(project, "select amount where item_amount > 5") == [(22.0,)]


def test_totals_match_null_dimensions(project):
    found = got(project, "select n.total within (shop) as t, kinds.total within (shop) as k by shop, size")
    assert found == [(None, 1, 2, 1), (None, 12, 2, 1), ("x", 3, 2, 2), ("x", 7, 2, 2), ("y", None, 2, 0), ("y", 12, 2, 0)]


def test_percent_of_zero_is_null(project):
    assert got(project, "select filled.percent within (shop) as p by shop, size")[0] == (None, 1, 0.0)
    assert got(project, "select amount.percent within (size) as p where size = 1 by size, shop") == [(1, None, None)]


def test_top_with_ties_takes_the_first_dimension(project):
    assert got(project, "select n by shop limit n.top(1)") == [(None, 2)]
    assert got(project, "select n by shop limit n.bottom(2)") == [(None, 2), ("x", 2)]
    assert got(project, "select n by shop limit amount.top(1), n.top(2)") == []
    assert got(project, "select n by shop limit amount.top(2), n.top(2)") == [("x", 2)]


def test_nulls_rank_last_both_ways(project):
    assert got(project, "select n by size limit amount.bottom(5)")[-1] == (12, 2) and (1, 1) not in got(project, "select n by size limit amount.bottom(4)")
    assert (1, 1) not in got(project, "select n by size limit amount.top(4)")


def test_top_within_matches_null_groups(project):
    assert got(project, "select amount by shop, size limit amount.top(1) within (shop)") == [(None, 12, 4.0), ("x", 3, 10.0), ("y", None, 8.0)]
    assert got(project, "select amount by shop, size limit amount.top(1) of (shop)") == [("y", None, 8.0), ("y", 12, 8.0)]
    assert got(project, "select n by shop limit n.top(0)") == []


def test_total_before_and_sum_after_a_limit(project):
    assert got(project, "select amount, amount.total as t, amount.sum as s, amount.percent as p by shop limit amount.top(2)") == [("x", 12.0, 32.0, 28.0, 0.375), ("y", 16.0, 32.0, 28.0, 0.5)]


def test_generic_time(project):
    assert got(project, "select n by shop") and got(project, 'select amount by "Week"') == [(None, 8.0), (dt.datetime(2021, 11, 29), None), (dt.datetime(2021, 12, 13), 10.0), (dt.datetime(2021, 12, 20), 6.0), (dt.datetime(2021, 12, 27), 8.0)]
    assert got(project, "select amount by Year.year as y, Month.month as m")[1] == (2021, 12, 24.0)


def test_metric_case_and_ratio_of_sums(project):
    assert got(project, "select either, mean") == [(1, 32.0 / 6)]


def test_transform_chains(project):
    assert got(project, "select n by size.step(10).gt(0) as big_size") == [(None, 1), (False, 3), (True, 2)]
    assert got(project, "select n where day.datetrunc('month').month = 12, shop.isnull.not by day.dow") == [(1, 1), (5, 1), (7, 1)]


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("select no", e.MissingQueryMetricError), ("select n by no", e.MissingQueryDimensionError), ("select n where no", e.MissingQueryDimensionError), ("select n by shop limit no.top(1)", e.MissingQueryMetricError),
        ("select n_items by shop", e.MissingQueryDimensionError), ("select per_item by shop", e.MissingQueryDimensionError), ("select n by Year", e.MissingQueryDimensionError), ('select amount by "Hour"', e.MissingQueryDimensionError),
        ("select n by shop.nothing", e.MissingTransformError), ("select n.nothing by shop", e.MissingTransformError), ("select n.top(1) by shop", e.MissingTransformError), ("select n by shop limit n.percent", e.MissingTransformError),
        ("select n by shop limit n", e.MissingTransformError), ("select n.total within (size) by shop", e.TransformDimensionError), ("select n.total of (day.year) by day.month", e.TransformDimensionError), ("select n by shop.year", e.TransformTypeError),
        ("select n by day.year.month", e.TransformTypeError), ("select n where size", e.TransformTypeError), ("select n by size.step", e.TransformTypeError), ("select n by shop limit n.top", e.TransformTypeError), ("select n by shop limit n.top('a')", e.TransformTypeError),
        ("select n, n by shop", e.DuplicateColumnError), ("select n as shop by shop", e.DuplicateColumnError), ("select n.total.percent by shop", e.TransformChainError), ("select n > 1 by shop", e.MissingTransformError),
    ],
)
def test_query_checks(project, text, error):
    with pytest.raises(error):
        project.ql(text).df()


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("3 / 2", 1.5), ("1 / 0", None), ("7 // 2", 3), ("-7 // 2", -4), ("7 % 4", 3), ("7 % 0", None), ("2 ** 3", 8.0), ("floor(-2.0)", -2), ("ceil(2.0)", 2), ("floor(2.7)", 2), ("ceil(2.1)", 3), ("abs(-3)", 3), ("tointeger('12')", 12),
        ("tofloat('1.5')", 1.5), ("coalesce(1 / 0, 4)", 4.0), ("if(FALSE, 1, TRUE, 2, 3)", 2), ("if(FALSE, 1)", None), ("case when 1 = 2 then 'a' else 'b' end", "b"), ("not (1 in (2, 3))", True), ("1 not in (1)", False),
        ("datepart('week', todatetime('2022-01-01 00:00:00'))", 52), ("datepart('dow', todatetime('2021-12-19 00:00:00'))", 7), ("datepart('dayofweek', todatetime('2021-12-20 00:00:00'))", 1), ("datepart('quarter', todate('2021-12-19'))", 4),
        ("datetrunc('week', todatetime('2021-12-19 14:05:38'))", dt.datetime(2021, 12, 13)), ("datetrunc('quarter', todatetime('2021-12-19 14:05:38'))", dt.datetime(2021, 10, 1)), ("todate('2021-12-19 14:05:38')", dt.datetime(2021, 12, 19)),
        ("datediff('year', todate('2021-12-31'), todate('2022-01-01'))", 1), ("datediff('quarter', todate('2021-12-31'), todate('2022-01-01'))", 1), ("datediff('month', todate('2022-01-01'), todate('2021-12-31'))", -1),
        ("datediff('week', todate('2021-12-19'), todate('2021-12-20'))", 1), ("datediff('day', todatetime('2021-12-19 23:59:59'), todatetime('2021-12-20 00:00:00'))", 1), ("datediff('hour', todatetime('2021-12-19 23:59:59'), todatetime('2021-12-20 00:00:00'))", 1),
        ("datediff('minute', todatetime('2021-12-19 23:58:59'), todatetime('2021-12-20 00:00:00'))", 2), ("datediff('second', todatetime('2021-12-20 00:00:01'), todatetime('2021-12-20 00:00:00'))", -1),
        ("now() >= today()", True), ("datediff('day', today(), now())", 0),
    ],
)
def test_functions(spark, text, value):
    found = spark.range(1).select(column_of(parse(text), None).alias("v")).first().v
    assert found == value


def test_leap_years(spark):
    tree = parse("if(y % 400 = 0, TRUE, y % 100 = 0, FALSE, y % 4 = 0)")
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1900,), (2000,), (2012,), (2013,)], "y int").select(column_of(tree, lambda n: F.col(n.value[0])).alias("v")).collect()
    assert [r.v for r in rows] == [False, True, True, False]


def test_only_needed_tables_are_read(project):
    plan = project.ql("select n by shop").df()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    plan = project.ql("select n, big, mean, amount by shop, kind").df()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.count("Join LeftOuter") == 1
