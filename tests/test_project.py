"""Projects: the fluent API, pivots, files, shorthand, formats and streams."""

import datetime as dt
import json

import pytest
import yaml

from meridian import errors as e
from meridian.formatting import Formatter, d3_number, d3_time, format_number, week_of
from meridian.functions.transforms import ScalarTransform, register
from meridian.plans.request import Dimension, Metric
from meridian.project import Project
from meridian.shorthand import Shorthand, parse_dimension, parse_format, parse_metric, parse_related, parse_table
from meridian.sources import files
from meridian.sources.tables import Catalog, register_source, source_kinds
from meridian.streaming.windows import windowed
from meridian.testmodel import MODEL
from meridian.types import Type

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def project(spark):
    return Project(spark, MODEL, Catalog(spark, SF))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_fluent_requests_are_the_written_ones(project):
    m, d = project.m, project.d
    fluent = project.select(m.revenue, m.revenue.percent(within=[d.customer_region]).name("p")).by(d.customer_region, d.order_date.year().name("y")).where(d.segment == "BUILDING", ~d.is_discounted, d.quantity > 3).limit(m.revenue.top(2, within=d.customer_region))
    written = project.ql("select revenue, revenue.percent() within (customer_region) as p where segment = 'BUILDING', is_discounted.not, quantity > 3 by customer_region, order_date.year as y limit revenue.top(2) within (customer_region)")
    assert fluent.query == written.query
    assert project.select("revenue.percent within (segment) as p").by("segment").query == project.ql("select revenue.percent within (segment) as p by segment").query
    assert "revenue" in dir(m) and "Year" in dir(d) and m["revenue"].item == Metric("revenue") and d.segment.render() == "segment"
    for bad in (lambda: m.nothing, lambda: d.nothing):
        with pytest.raises(AttributeError):
            bad()


def test_steps_do_not_change_the_analysis_they_start_from(project):
    start = project.select("line_count")
    start.by("segment")
    assert start.query.dimensions == () and len(start.by("segment").query.dimensions) == 1


def test_pivot(project):
    long = {(r[0], r[1]): r[2] for r in rows(project.ql("select line_count by segment, return_flag").df())}
    wide = project.pivot("line_count").rows("segment").columns("return_flag").df()
    assert wide.columns == ["segment", "A / line_count", "N / line_count", "R / line_count"]
    assert {(r[0], c[0]): r[c] for r in wide.collect() for c in wide.columns[1:]} == long
    both = project.pivot("line_count", "items_sold").rows("$").columns("return_flag").df()
    assert both.columns == ["$", "A", "N", "R"] and [r[0] for r in both.collect()] == ["items_sold", "line_count"]
    assert project.pivot("line_count").columns("return_flag").df().count() == 1
    assert project.pivot("line_count").rows("segment", "$").columns("$").query.dimensions == (Dimension("segment"),)
    assert rows(project.pivot("line_count").df()) == rows(project.ql("select line_count").df())


def test_describe_and_suggestions(project):
    found = {r["dimension"]: r.asDict() for r in project.describe().collect()}
    assert found["brand"]["revenue"] == "+" and found["brand"]["n_customers"] is None and found["Year"]["revenue"] == "+" and found["nation_u"]["n_suppliers"] == "+"
    assert found["nation_name"]["revenue"] is None and found["customer_nation"]["revenue"] == "+"
    assert "segment" in project.suggest_dimensions("revenue", "order_count") and "brand" not in project.suggest_dimensions("revenue", "order_count")
    assert "revenue" in project.suggest_metrics("brand") and "n_customers" not in project.suggest_metrics("brand")
    with pytest.raises(e.MissingQueryDimensionError):
        project.ql("select revenue by nation_name").df()


def test_formatted_results(project):
    found = project.ql("select revenue, return_rate, revenue.percent as p by order_date.datetrunc('year') as y limit revenue.top(1)")
    (y, revenue, rate, p), = rows(found.df(format=True))
    assert y.isdigit() and revenue.startswith("$") and "," in revenue and rate.endswith("%") and p.endswith("%")
    shown = found.toPandas(format=True)
    assert shown.iloc[0].tolist() == [y, revenue, rate, p]


def test_update_is_whole_or_not_at_all(project):
    own = Project(project.spark, MODEL, project.catalog)
    with pytest.raises(e.ModelError):
        own.update({"metrics": {"broken": {"expr": "$nothing"}}})
    assert "broken" not in own.model.metrics and "broken" not in own.data["metrics"]
    own.update({"metrics": {"double_revenue": {"expr": "$revenue * 2"}}})
    assert rows(own.ql("select double_revenue").df())[0][0] == pytest.approx(2 * rows(own.ql("select revenue").df())[0][0])
    with pytest.raises(e.ProjectError):
        own.write()


def test_shorthand_parts():
    assert parse_table("test") == {"tables": {"test": {"source": "test"}}}
    assert parse_table("test[pk] src") == {"tables": {"test": {"source": "src", "primary_key": "pk"}}}
    assert parse_table("test[pk] { schema=public table=what }")["tables"]["test"]["source"] == {"schema": "public", "table": "what"}
    assert parse_metric('t.x = sum(a * b) where c > 0 ::int as "X y" { time=d format={ kind=currency currency=EUR } }') == {
        "metrics": {"x": {"expr": "sum(a * b)", "table": "t", "filter": "c > 0", "type": "int", "name": "X y", "time": "d", "format": {"kind": "currency", "currency": "EUR"}}}
    }
    assert parse_dimension("t.d = a.b in (1, 2) ::bool as z") == {"tables": {"t": {"dimensions": {"d": {"expr": "a.b in (1, 2)", "type": "bool", "name": "z"}}}}}
    assert parse_dimension("t.d = x ::date:month")["tables"]["t"]["dimensions"]["d"]["type"] == "date:month"
    assert parse_related("t.r = k -> other.id") == {"tables": {"t": {"related": {"r": {"foreign_key": "k", "table": "other", "related_key": "id"}}}}}
    assert parse_format("currency") == "currency" and parse_format("kind=currency currency=USD") == {"kind": "currency", "currency": "USD"}
    cell = parse_table("test\nrelated r = k -> other\nmetric n = count()\ndimension d = x / 2 ::float\nformat n decimal")
    assert cell["tables"]["test"]["related"] == {"r": {"foreign_key": "k", "table": "other"}} and cell["metrics"]["n"] == {"expr": "count()", "table": "test"} and cell["formats"] == {"n": "decimal"}
    for bad, part in (("x = y", parse_dimension), ("t.x = y", parse_dimension), ("x = y ::int", parse_dimension), ("r = k -> t", parse_related), ("x sum(y)", parse_metric), ("t { a=", parse_table)):
        with pytest.raises((e.ShorthandSyntaxError, e.ExpressionSyntaxError)):
            part(bad)


def test_project_from_scratch(spark, tmp_path):
    p = Project.new(spark, tmp_path / "p", "sales", "parquet", {"path": SF})
    with pytest.raises(e.ProjectError):
        Project.new(spark, tmp_path / "p")
    s = Shorthand(p)
    s.table("customer[c_custkey]", "dimension segment = c_mktsegment ::str\nmetric customers = count() ::int\nformat customers decimal")
    s.table("orders[o_orderkey]", "related customer = o_custkey -> customer\ndimension ordered = o_orderdate ::date")
    s.metric("orders.value = sum(o_totalprice) { time=ordered format=currency }")
    s.metric("per_customer = $value / $customers as Each")
    s.related("orders.buyer = o_custkey -> customer.c_custkey")
    s.format("per_customer kind=currency currency=EUR")
    assert {x.name for x in p.write()} == {"customer.yml", "orders.yml", "customers.yml", "value.yml", "per_customer.yml"} and p.write() == []
    assert yaml.safe_load((tmp_path / "p/metrics/value.yml").read_text()) == {"expr": "sum(o_totalprice)", "table": "orders", "time": "ordered", "format": "currency"}
    s.metric("per_customer = $value / $customers as \"Value of each\"")
    assert [x.name for x in p.write()] == ["per_customer.yml"]
    again = Project.from_path(spark, tmp_path / "p")
    assert again.model.metrics["per_customer"].name == "Value of each" and rows(again.ql("select value, customers").df()) == rows(p.ql("select value, customers").df())
    (tmp_path / "p/tables/more").mkdir()
    (tmp_path / "p/tables/more/orders.yml").write_text("source: orders")
    with pytest.raises(e.ProjectError):
        Project.from_path(spark, tmp_path / "p")


def test_profiles_take_environment_values(tmp_path, monkeypatch):
    files.scaffold(tmp_path, "x", "parquet", {"path": "{{ env.WHERE_DATA_IS }}"})
    settings = files.load_project(tmp_path)
    with pytest.raises(e.ProjectError):
        files.load_profile(settings)
    assert files.load_profile(settings, ask=lambda name: f"/asked/{name}")["parameters"] == {"path": "/asked/WHERE_DATA_IS"}
    monkeypatch.setenv("WHERE_DATA_IS", "/there")
    assert files.load_profile(settings)["parameters"] == {"path": "/there"}
    for bad in ("nothing", tmp_path / "tables"):
        with pytest.raises(e.ProjectError):
            files.load_project(bad)
    with pytest.raises(e.ProjectError):
        files.load_profile(settings, "other")


def test_sources(spark, tmp_path):
    catalog = Catalog(spark)
    spark.read.parquet(f"{SF}/region.parquet").createOrReplaceTempView("region_view")
    spark.read.parquet(f"{SF}/region.parquet").write.csv(str(tmp_path / "c"), header=True)
    assert catalog.frame("region_view").count() == catalog.frame({"path": f"{SF}/region.parquet"}).count() == catalog.frame({"format": "csv", "path": str(tmp_path / "c"), "options": {"header": "true"}}).count() == 5
    spark.sql("create database if not exists shop location '" + str(tmp_path / "db") + "'")
    catalog.frame("region_view").write.mode("overwrite").saveAsTable("shop.region")
    assert catalog.frame({"schema": "shop", "table": "region"}).count() == Catalog(spark, default_schema="shop").frame("region").count() == 5
    spark.sql("drop database shop cascade")
    assert catalog.frame({"type": "query", "sql": "select 1 as x"}).first().x == 1
    register_source("numbers", lambda s, source: s.range(source["n"]))
    assert "numbers" in source_kinds() and catalog.frame({"type": "numbers", "n": 3}).count() == 3
    for bad in ({"type": "unknown"}, {}, 5):
        with pytest.raises(e.ModelError):
            catalog.frame(bad)
    with pytest.raises(e.ModelError):
        Catalog.from_profile(spark, "other", {})


def test_registered_transform(project):
    register(ScalarTransform("double", ("int", "float"), lambda c: c * 2, lambda t, _: t))
    assert {r[0] for r in rows(project.ql("select n_parts by part_size.double").df())} == {2 * r[0] for r in rows(project.ql("select n_parts by part_size").df())}


@pytest.mark.parametrize(
    ("value", "pattern", "text"),
    [
        (1.0, "#,##0.###", "1"), (1234567.891, "#,##0.##", "1,234,567.89"), (-5, "#;(#)", "(5)"), (0.256, "#,##0%", "26%"), (2.5, "0", "2"), (3.5, "0", "4"), (7, "0000", "0007"), (12345678, "#,##,##0", "1,23,45,678"),
        (0.5, "#.00", ".50"), (0.5, "0.00", "0.50"), (12345, "0.##E0", "1.23E4"), (0.00012, "0.0E00", "1.2E-04"), (123456, "@@@", "123000"), (3.14159, "@@##", "3.142"), (float("nan"), "0", "NaN"), (float("inf"), "0", "∞"),
    ],
)
def test_number_patterns(value, pattern, text):
    assert format_number(value, pattern) == text


# Specifiers that number patterns must give.
@pytest.mark.parametrize(
    ("pattern", "d3"),
    [
        ("#", "d"), ("+#", "+d"), ("#;(#)", "(d"), (" #;-#", " d"), ("¤#", "$d"), ("#¤", "$d"), ("0000", "04d"), ("#,#00", "02,d"), ("#,##,###", ",d"), ("#.##", ".2~f"), ("#.00", ".2f"), ("#.00##", ".4~f"),
        ("#%", ".0%"), ("%#", ".0%"), ("#.##E#", ".2~e"), ("#.00E#", ".2e"), ("#.##E", ".2~f"), ("#.", "d"), ("@@@", ".3r"), ("@@@##", ".5~r"), ("#,##0%", "01,.0%"),
    ],
)
def test_d3_numbers(pattern, d3):
    assert d3_number(pattern) == d3


def test_values_as_text():
    # The moment and its texts.
    at = dt.datetime(2022, 11, 17, 12, 33, 11)
    text = lambda grain: Formatter(Type("datetime", grain)).text(at)
    assert [text(g) for g in ("year", "quarter", "month", "week", "day")] == ["2022", "Q4 2022", "November 2022", "week 47 of 2022", "11/17/2022"]
    assert text("hour") == text("minute") == "11/17/22, 12:33 PM" and text("second") == "Nov 17, 2022, 12:33:11 PM"
    assert week_of(dt.datetime(2022, 1, 1)) == (2022, 1) and week_of(dt.datetime(2021, 12, 26)) == (2022, 1) and week_of(dt.datetime(2022, 12, 31)) == (2022, 53)
    for kind, value, shown in (("float", 1.0, "1"), ("int", 1, "1"), ("bool", True, "True"), ("str", "abc", "abc"), ("str", None, ""), ("int", None, ""), ("float", float("nan"), "")):
        assert Formatter(Type(kind)).text(value) == shown
    assert Formatter(Type("float"), "currency").text(-1234.5) == "-$1,234.50" and Formatter(Type("float"), {"kind": "currency", "currency": "JPY"}).text(1234.5) == "¥1,234"
    assert Formatter(Type("datetime", "day"), {"kind": "date", "skeleton": "yMMMd"}).text(at) == "Nov 17, 2022" and Formatter(Type("datetime", "day"), {"kind": "date", "pattern": "yyyy-MM-dd 'at' HH"}).text(at) == "2022-11-17 at 12"
    assert Formatter(Type("float"), "percent").d3 == "01,.0%" and Formatter(Type("str")).d3 is None and d3_time("yyyy-MM-dd") == "%Y-%m-%d"
    for bad in ({"kind": "number", "skeleton": "y"}, {"kind": "date", "skeleton": "y", "pattern": "y"}, {"kind": "date", "skeleton": "??"}):
        with pytest.raises(ValueError):
            Formatter(Type("datetime", "day"), bad)


def test_example(spark):
    p = Project.example(spark)
    got = rows(p.ql("select takings, copies_sold, price_paid, gift_share by side limit takings.top(1)").df())
    prices = (40.0, 12.5, 15.0, 17.5)
    sold = [(i % 7 % 3 < 2, prices[i * i % 4], 1 + i % 5, i % 6 == 0) for i in range(180)]
    want = {north: (sum(n * x for s, x, n, _ in sold if s == north), sum(n for s, _, n, _ in sold if s == north), sum(n for s, _, n, g in sold if s == north and g)) for north in (True, False)}
    taken, copies, gifts = max(want.values())
    assert got == [("North", taken, copies, pytest.approx(taken / copies), pytest.approx(gifts / copies))]
    outline = p.outline()
    assert json.loads(json.dumps(outline)) == outline and outline["name"] == "bookshops"
    takings = {m["id"]: m for m in outline["metrics"]}["takings"]
    assert takings["type"] == {"name": "float", "grain": None} and {d["id"] for d in takings["dimensions"]} == {"gift", "shop", "side", "size_class", "sold_on", "title", "genre"}
    assert "Year" in takings["time"] and {"column:books.price", "column:sales.copies"} <= {x["id"] for x in takings["lineage"]} and takings["format"]["d3"] == "$01,.2f"


def test_locales():
    at, texts = dt.datetime(2021, 3, 7, 15, 4, 5), {}
    for name in ("en_GB", "de_DE", "fr-FR", "es", "xx_YY"):
        f = lambda kind, config=None: Formatter(Type(kind) if kind != "datetime" else Type("datetime", config), None if kind == "datetime" else config, name, "EUR")  # noqa: B023, E731
        texts[name] = [f("float").text(-1234567.5), f("float", "currency").text(1234.5), f("float", "percent").text(0.25), *(f("datetime", g).text(at) for g in ("quarter", "month", "week", "day", "second"))]
    assert texts["en_GB"] == ["-1,234,567.5", "€1,234.50", "25%", "Q1 2021", "March 2021", "week 9 of 2021", "07/03/2021", "7 Mar 2021, 15:04:05"]
    assert texts["de_DE"] == ["-1.234.567,5", "1.234,50\xa0€", "25\xa0%", "Q1 2021", "März 2021", "Woche 9 des Jahres 2021", "07.03.2021", "07.03.2021, 15:04:05"]
    assert texts["fr-FR"] == ["-1\u202f234\u202f567,5", "1\u202f234,50\xa0€", "25\u202f%", "T1 2021", "mars 2021", "semaine 9 de 2021", "07/03/2021", "7 mars 2021, 15:04:05"]
    assert texts["es"][4] == "marzo de 2021" and texts["xx_YY"][0] == "-1,234,567.5" and texts["xx_YY"][-2] == "3/7/2021"


def test_windows_of_a_stream(spark, project, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = windowed(project.model, project.catalog, stream, "events", ["n_events"], "ts", "7 days", "1 day", (Dimension("event_type"), Dimension("segment")))
    query = out.writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    found = spark.table("windows")
    assert found.columns == ["window_start", "window_end", "event_type", "segment", "n_events"]
    by = {(r.event_type, r.segment): r.n for r in found.groupBy("event_type", "segment").agg({"n_events": "sum"}).withColumnRenamed("sum(n_events)", "n").collect()}
    assert by == {(r[0], r[1]): r[2] for r in rows(project.ql("select n_events by event_type, segment").df())}
    with pytest.raises(e.QueryError):
        windowed(project.model, project.catalog, stream, "events", ["active_users"], "ts", "1 day", "1 day")


def test_databases(spark, tmp_path):
    """An SQLite file by the package's own reader, and a database by JDBC."""
    import sqlite3

    path = str(tmp_path / "sho?p.db")
    with sqlite3.connect(path) as db:
        db.execute("create table sales (id integer primary key, shop varchar(20), price numeric(10, 2), sold datetime, paid boolean, raw blob)")
        db.executemany("insert into sales values (?, ?, ?, ?, ?, ?)", [(i, None if i == 4 else f"s{i % 3}", i / 4, "2024-01-31 10:11:12", i % 2, b"x") for i in range(1, 101)])
        db.execute("create view cheap as select * from sales where price < 2")
        db.execute("create table vacant (id integer)")
    db.close()
    catalog = Catalog(spark)
    read = lambda t, **options: catalog.frame({"type": "sqlite", "database": path, "table": t, "options": options})
    df = read("sales", partitions="7")
    assert df.dtypes == [("id", "bigint"), ("shop", "string"), ("price", "double"), ("sold", "timestamp_ntz"), ("paid", "boolean"), ("raw", "binary")]
    assert df.rdd.getNumPartitions() == 7 and df.count() == 100 and df.where("shop is null").count() == 1
    assert rows(df.where("id = 5")) == [(5, "s2", 1.25, dt.datetime(2024, 1, 31, 10, 11, 12), True, b"x")]
    assert read("cheap").count() == 7 and read("vacant").count() == 0
    with pytest.raises(Exception, match="no table"):
        read("missing").count()
    url = "jdbc:derby:memory:shop;create=true"
    df.select("id", "shop", "price").write.jdbc(url, "sales", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    model = {"tables": {"sales": {"source": {"type": "jdbc", "url": url, "table": "sales", "options": {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}}, "primary_key": "id",
                                  "dimensions": {"shop": {"type": "str", "expr": "shop"}}, "measures": {"taken": {"expr": "sum(price)"}, "n": {"expr": "count()", "type": "int"}}}}}
    by_jdbc = rows(Project(spark, model).ql("select taken, n by shop").df())
    model["tables"]["sales"]["source"] = {"type": "sqlite", "database": path, "table": "sales"}
    assert by_jdbc == rows(Project(spark, model).ql("select taken, n by shop").df()) and sum(r[2] for r in by_jdbc) == 100


def test_an_overwritten_table_is_read_with_its_new_columns(spark, tmp_path):
    catalog, path = Catalog(spark, str(tmp_path)), f"{tmp_path}/t.parquet"
    spark.createDataFrame([(1,)], "a long").write.parquet(path)
    assert catalog.frame("t").columns == ["a"]
    spark.createDataFrame([(1, "x")], "a long, b string").write.mode("overwrite").parquet(path)
    assert rows(catalog.frame("t")) == [(1, "x")]


def test_listings(project):
    want = {(r[0], r[1]) for r in rows(project.ql("select line_count by customer_region, segment").df())}
    got = rows(project.select().by("customer_region", "segment").df())
    assert want <= set(got) and len(got) == len(set(got)) and got == sorted(got)
    assert {r[0] for r in rows(project.ql("select where return_flag not in ('A') by return_flag").df())} == {"N", "R"}
    assert project.select().by("segment").query.render() == "select  by segment" and project.ql("select  by segment").query == project.select().by("segment").query
    with pytest.raises(e.MissingQueryMetricError):
        project.select().df()
    with pytest.raises(e.MissingQueryDimensionError):
        project.select().by("brand", "event_type").df()


def test_what_ran_is_noted(project):
    found = project.ql("select line_count by segment")
    assert len(found.toPandas()) == 5 and len(found.executed) == 1
    assert "Physical Plan" in found.executed[0].plan and found.executed[0].seconds > 0
    graph = found.graph()
    assert graph.startswith("digraph") and "Aggregate" in graph and graph.count("->") == graph.count("label") - 1


def test_windows_over_what_is_left(project):
    got = rows(project.ql("select buyers, buyers.avg as a, buyers.min as lo, buyers.max as hi, buyers.count as n, buyers.sum as s by segment limit buyers.top(3)").df())
    values = [r[1] for r in got]
    assert len(got) == 3 and {r[2:] for r in got} == {(sum(values) / 3, min(values), max(values), 3, sum(values))}
