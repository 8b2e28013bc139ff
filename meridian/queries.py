"""The registered queries of the metrics layer over the test model, each with the same result in SQL.

Sums of floating-point numbers depend on their order, so both sides round them to the data's precision.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .project import Project
from .sources.tables import Catalog
from .testmodel import MODEL

#: Digits kept of every floating-point column.
DIGITS = 4


@functools.lru_cache(4)
def project(spark: SparkSession, sf_dir: str) -> Project:
    return Project(spark, MODEL, Catalog(spark, sf_dir))


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*(F.round(f"`{c}`", digits).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes))


_F = """with f as (
  select l.*, o.o_custkey, o.o_orderdate, o.o_orderpriority, o.o_orderstatus, o.o_totalprice, c.c_mktsegment as segment, n.n_name as nation, r.r_name as customer_region,
         p.p_brand as brand, p.p_type as part_type, p.p_size as part_size, l.l_extendedprice * (1 - l.l_discount) as amt
  from lineitem l left join orders o on l.l_orderkey = o.o_orderkey left join customer c on o.o_custkey = c.c_custkey
  left join nation n on c.c_nationkey = n.n_nationkey left join region r on n.n_regionkey = r.r_regionkey left join part p on l.l_partkey = p.p_partkey)
"""
_REV = "round(coalesce(sum(amt), 0), 4) as revenue"
_TOP = "select * from (select {by}, row_number() over ({within} order by {value} {way} nulls last, {ties}) rn from f group by {group}) where rn <= {n}"


def _by(columns: str, values: str, more: str = "") -> str:
    return f"{_F} select {columns}, {values} from f {more} group by all"


def _time(grain: str, name: str) -> str:
    t = lambda c: f"date_trunc('{grain}', {c})"
    return f"""{_F} select coalesce(a.k, b.k)::timestamp as "{name}", coalesce(a.v, 0) as revenue, b.v as order_value
      from (select {t('l_shipdate')} k, round(sum(amt), 4) v from f group by 1) a full join (select {t('o_orderdate')} k, round(sum(o_totalprice), 4) v from orders group by 1) b on a.k = b.k"""


def _datediff(part: str, column: str = "ts", start: str = "2023-12-31 23:59:59") -> str:
    a = f"timestamp '{start}'"
    if part == "week":
        return f"datediff('day', date_trunc('week', {a}), date_trunc('week', {column})) // 7"
    return f"datediff('{part}', {a}, {column})"


_BRAND = "select brand, sum(amt) v, count(distinct o_custkey) b from f group by 1"
_RS = "select customer_region, segment, sum(amt) v, count(distinct o_custkey) b from f group by 1, 2"
_RSB = "select customer_region, segment, brand, sum(amt) v from f group by 1, 2, 3"

#: name: (request, SQL)
REQUESTS: dict[str, tuple[str, str]] = {
    "q_by_region": ("select revenue, buyers by customer_region", _by("customer_region", f"{_REV}, count(distinct o_custkey) as buyers")),
    "q_total_revenue": ("select revenue", f"{_F} select {_REV} from f"),
    "q_aggs": (
        "select items_sold, avg_discount, min_price, max_price, line_count, counted_flags, last_ship by return_flag, line_status",
        _by("l_returnflag as return_flag, l_linestatus as line_status", "round(sum(l_quantity), 4) as items_sold, round(avg(l_discount), 4) as avg_discount, round(min(l_extendedprice), 4) as min_price, round(max(l_extendedprice), 4) as max_price, count(*) as line_count, count(l_returnflag) as counted_flags, max(l_shipdate) as last_ship"),
    ),
    "q_cond_agg": ("select urgent_lines by segment", _by("segment", "count(case when o_orderpriority = '1-URGENT' then 1 end) as urgent_lines")),
    "q_filter_ops": (
        "select revenue where order_value_bin >= 100000, return_flag in ('A', 'R'), order_date.inrange('1996-01-01', '1997-12-31') by segment",
        _by("segment", _REV, "where floor(o_totalprice / 50000) * 50000 >= 100000 and l_returnflag in ('A', 'R') and o_orderdate between '1996-01-01' and '1997-12-31'"),
    ),
    "q_comparisons": (
        "select line_count where quantity > 3, quantity < 40, quantity.le(39), quantity != 7, return_flag.eq('N'), return_flag.ne('A'), quantity.ge(4) by line_status",
        _by("l_linestatus as line_status", "count(*) as line_count", "where l_quantity > 3 and l_quantity < 40 and l_quantity <= 39 and l_quantity <> 7 and l_returnflag = 'N' and l_returnflag <> 'A' and l_quantity >= 4"),
    ),
    "q_invert": ("select line_count where is_discounted.not", f"{_F} select count(*) as line_count from f where not (l_discount > 0.05)"),
    "q_isnull": ("select line_count where segment is not null by segment.isnull as no_segment", _by("segment is null as no_segment", "count(*) as line_count", "where segment is not null")),
    "q_bool_dim": ("select line_count where is_discounted by is_discounted", _by("l_discount > 0.05 as is_discounted", "count(*) as line_count", "where l_discount > 0.05")),
    "q_step": ("select n_parts by part_size.step(10)", "select cast(floor(p_size / 10) * 10 as bigint) as part_size__step_10, count(*) as n_parts from part group by 1"),
    "q_bins": ("select order_count by order_value_bin", "select cast(floor(o_totalprice / 50000) * 50000 as bigint) as order_value_bin, count(*) as order_count from orders group by 1"),
    "q_datepart": (
        "select order_count by order_date.year, order_date.quarter, order_date.month, order_date.dow",
        "select year(o_orderdate) as order_date__year, quarter(o_orderdate) as order_date__quarter, month(o_orderdate) as order_date__month, isodow(o_orderdate) as order_date__dow, count(*) as order_count from orders group by all",
    ),
    "q_datepart_fine": (
        "select n_events by event_ts.week, event_ts.day, event_ts.datepart('hour') as h, event_ts.minute.step(30) as m, event_ts.second.step(30) as s",
        "select week(ts) as event_ts__week, day(ts) as event_ts__day, hour(ts) as h, cast(floor(minute(ts) / 30) * 30 as bigint) as m, cast(floor(second(ts) / 30) * 30 as bigint) as s, count(*) as n_events from events group by all",
    ),
    **{
        f"q_datetrunc_{g}": (f"select n_events by event_ts.datetrunc('{g}') as t", f"select date_trunc('{g}', ts)::timestamp as t, count(*) as n_events from events group by 1")
        for g in ("year", "quarter", "month", "week", "day", "hour", "minute", "second")
    },
    "q_date": ("select n_events by event_ts.date", "select date_trunc('day', ts)::timestamp as event_ts__date, count(*) as n_events from events group by 1"),
    **{f"q_datediff_{p}": (f"select n_events by {p}s_in", f"select cast({_datediff(p)} as bigint) as {p}s_in, count(*) as n_events from events group by 1") for p in ("year", "quarter", "month", "week", "day", "hour", "minute", "second")},
    "q_last": ("select n_events where event_ts.last(100000, 'day') by event_type", "select event_type, count(*) as n_events from events where datediff('day', ts, now()::timestamp) <= 100000 group by 1"),
    **{
        f"q_order_trunc_{g}": (f"select order_count by order_date.datetrunc('{g}') as t", f"select date_trunc('{g}', o_orderdate)::timestamp as t, count(*) as order_count from orders group by 1")
        for g in ("year", "quarter", "month", "week")
    },
    **{
        f"q_order_diff_{p}": (f"select order_count by order_{p}s_in", f"select cast({_datediff(p, 'o_orderdate', '1995-06-17 12:00:00')} as bigint) as order_{p}s_in, count(*) as order_count from orders group by 1")
        for p in ("year", "quarter", "month", "week", "day")
    },
    "q_last_cut": ("select order_count where order_date.last(360, 'month') by order_priority", "select o_orderpriority as order_priority, count(*) as order_count from orders where datediff('month', o_orderdate, now()::timestamp) <= 360 group by 1"),
    "q_not_in": ("select line_count where return_flag not in ('A', 'N') by line_status", _by("l_linestatus as line_status", "count(*) as line_count", "where l_returnflag not in ('A', 'N')")),
    "q_listing": ("select by customer_region, segment", "select distinct r_name as customer_region, c_mktsegment as segment from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"),
    "q_listing_where": ("select where return_flag = 'R' by brand, line_status", f"{_F} select distinct brand, l_linestatus as line_status from f where l_returnflag = 'R'"),
    "q_windows": (
        "select buyers.avg within (customer_region) as a, buyers.min within (customer_region) as lo, buyers.max of (segment) as hi, buyers.count as n by customer_region, segment",
        f"{_F}, b as ({_RS}) select customer_region, segment, round(avg(b) over r, 4) as a, min(b) over r as lo, max(b) over (partition by segment) as hi, count(*) over () as n from b window r as (partition by customer_region)",
    ),
    "q_top_of_unselected": ("select buyers by customer_region, segment limit revenue.top(2) of (segment)", f"{_F}, b as ({_RS}) select customer_region, segment, b as buyers from b where segment in (select segment from f group by 1 order by sum(amt) desc, segment limit 2)"),
    "q_measure_filter": ("select revenue, returned_revenue, asian_revenue by segment", _by("segment", f"{_REV}, round(sum(amt) filter (where l_returnflag = 'R'), 4) as returned_revenue, round(sum(amt) filter (where customer_region in ('ASIA')), 4) as asian_revenue")),
    "q_only_filtered": ("select returned_revenue, asian_revenue by customer_region", _by("customer_region", "round(sum(amt) filter (where l_returnflag = 'R'), 4) as returned_revenue, round(sum(amt) filter (where customer_region in ('ASIA')), 4) as asian_revenue", "where l_returnflag = 'R' or customer_region in ('ASIA')")),
    "q_table_filter": ("select returned_total by brand", _by("brand", "round(sum(amt), 4) as returned_total", "where l_returnflag = 'R'")),
    "q_drill_across": (
        "select revenue, n_parts, returned_total by brand",
        f"{_F} select a.k as brand, coalesce(b.v, 0) as revenue, a.n as n_parts, b.r as returned_total from (select p_brand k, count(*) n from part group by 1) a left join (select brand k, round(sum(amt), 4) v, round(sum(amt) filter (where l_returnflag = 'R'), 4) r from f group by 1) b on a.k = b.k",
    ),
    "q_drill_across_dates": (
        "select order_count, returned_revenue by order_priority",
        f"{_F} select a.k as order_priority, a.n as order_count, b.v as returned_revenue from (select o_orderpriority k, count(*) n from orders group by 1) a full join (select o_orderpriority k, round(sum(amt), 4) v from f where l_returnflag = 'R' group by 1) b on a.k is not distinct from b.k",
    ),
    "q_cross_merge": ("select revenue, n_parts, n_events, n_customers, avg_retail, avg_balance", f"{_F} select (select round(sum(amt), 4) from f) as revenue, (select count(*) from part) as n_parts, (select count(*) from events) as n_events, (select count(*) from customer) as n_customers, (select round(avg(p_retailprice), 4) from part) as avg_retail, (select round(avg(c_acctbal), 4) from customer) as avg_balance"),
    "q_union": (
        "select n_customers, n_suppliers by nation_u",
        "select coalesce(a.k, b.k) as nation_u, a.n as n_customers, b.n as n_suppliers from (select n_name k, count(*) n from customer join nation on c_nationkey = n_nationkey group by 1) a full join (select n_name k, count(*) n from supplier join nation on s_nationkey = n_nationkey group by 1) b on a.k = b.k",
    ),
    **{f"q_generic_{n.lower()}": (f"select revenue, order_value by {n}", _time(g, n)) for n, g in (("Year", "year"), ("Quarter", "quarter"), ("Month", "month"), ("Week", "week"), ("Day", "day"), ("Date", "day"))},
    "q_generic_fine": ('select n_events, active_users by Hour, "Minute".datepart(\'minute\') as m', "select date_trunc('hour', ts)::timestamp as \"Hour\", minute(ts) as m, count(*) as n_events, count(distinct user_id) as active_users from events group by all"),
    "q_generic_time": ("select n_events, event_value by Time", "select date_trunc('second', ts)::timestamp as \"Time\", count(*) as n_events, round(sum(value), 4) as event_value from events group by 1"),
    "q_generic_filter": ("select revenue, order_value where Year.inrange('1996-01-01', '1996-12-31')", f"{_F} select (select round(sum(amt), 4) from f where year(l_shipdate) = 1996) as revenue, (select round(sum(o_totalprice), 4) from orders where year(o_orderdate) = 1996) as order_value"),
    "q_agg_dim_bin": ("select n_customers by customer_value_bin", "select cast(floor(s.v / 100000) * 100000 as bigint) as customer_value_bin, count(*) as n_customers from customer c left join (select o_custkey pk, sum(o_totalprice) v from orders group by 1) s on s.pk = c.c_custkey group by 1"),
    "q_agg_dim_far": ("select revenue, line_count by customer_value_bin", f"{_F} select cast(floor(s.v / 100000) * 100000 as bigint) as customer_value_bin, {_REV}, count(*) as line_count from f left join (select o_custkey pk, sum(o_totalprice) v from orders group by 1) s on s.pk = f.o_custkey group by 1"),
    "q_agg_dim_missing": ("select order_count by order_lines", "select coalesce(s.n, 0) as order_lines, count(*) as order_count from orders left join (select l_orderkey pk, count(*) n from lineitem group by 1) s on s.pk = o_orderkey group by 1"),
    "q_cohort": ("select order_count by cohort_month", "select cast((year(o_orderdate) - year(s.v)) * 12 + month(o_orderdate) - month(s.v) as bigint) as cohort_month, count(*) as order_count from orders o left join (select o_custkey pk, min(o_orderdate) v from orders group by 1) s on s.pk = o.o_custkey group by 1"),
    "q_ratio": ("select return_rate, revenue_per_line by brand", _by("brand", "round(sum(amt) filter (where l_returnflag = 'R') / nullif(coalesce(sum(amt), 0), 0), 4) as return_rate, round(sum(amt) / count(*), 4) as revenue_per_line")),
    "q_metric_nested": ("select metric_of_metric, revenue_per_part, avg_order_value, orders_or_zero, parts_listed", f"{_F} select round((select sum(amt) / count(distinct o_custkey) from f) / 100, 4) as metric_of_metric, round((select sum(amt) from f) / (select count(*) from part), 4) as revenue_per_part, (select round(sum(o_totalprice) / count(*), 4) from orders) as avg_order_value, (select count(*) from orders) as orders_or_zero, (select count(*) from part) as parts_listed"),
    "q_total": ("select revenue, revenue.total by brand", f"{_F} select brand, {_REV}, (select round(sum(amt), 4) from f) as revenue__total from f group by brand"),
    "q_total_countd": ("select buyers, buyers.total by brand", f"{_F} select brand, count(distinct o_custkey) as buyers, (select count(distinct o_custkey) from f) as buyers__total from f group by brand"),
    "q_total_within": ("select buyers.total within (customer_region), max_price.total of (segment) as top_price by customer_region, segment", f"{_F}, b as ({_RS}) select b.customer_region, b.segment, t.n as buyers__total_within_customer_region, u.n as top_price from b join (select customer_region, count(distinct o_custkey) n from f group by 1) t on t.customer_region = b.customer_region join (select segment, round(max(l_extendedprice), 4) n from f group by 1) u on u.segment = b.segment"),
    "q_percent": ("select revenue.percent by brand", f"{_F}, b as ({_BRAND}) select brand, round(v / sum(v) over (), 4) as revenue__percent from b"),
    "q_percent_within": ("select revenue.percent within (customer_region) as pct by customer_region, segment", f"{_F}, b as ({_RS}) select customer_region, segment, round(v / sum(v) over (partition by customer_region), 4) as pct from b"),
    "q_percent_of": ("select revenue.percent of (segment) as pct by customer_region, segment", f"{_F}, b as ({_RS}) select customer_region, segment, round(v / sum(v) over (partition by customer_region), 4) as pct from b"),
    "q_percent_of_within": ("select revenue.percent of (segment) within (customer_region) as pct by customer_region, segment, brand", f"{_F}, b as ({_RSB}) select customer_region, segment, brand, round(sum(v) over (partition by customer_region, segment) / sum(v) over (partition by customer_region), 4) as pct from b"),
    "q_percent_countd": ("select buyers.percent by brand", f"{_F}, b as ({_BRAND}) select brand, round(b / (select count(distinct o_custkey) from f), 4) as buyers__percent from b"),
    "q_sum": ("select revenue.sum by brand", f"{_F}, b as ({_BRAND}) select brand, round(sum(v) over (), 4) as revenue__sum from b"),
    "q_sum_within": ("select buyers.sum within (customer_region) as s by customer_region, segment", f"{_F}, b as ({_RS}) select customer_region, segment, cast(sum(b) over (partition by customer_region) as bigint) as s from b"),
    "q_top": ("select revenue by brand limit revenue.top(5)", f"{_F} select brand, round(v, 4) as revenue from ({_BRAND}) order by v desc, brand limit 5"),
    "q_bottom": ("select buyers by brand limit buyers.bottom(4)", f"{_F} select brand, b as buyers from ({_BRAND}) order by b, brand limit 4"),
    "q_top_other_metric": ("select buyers by brand limit revenue.top(5)", f"{_F} select brand, b as buyers from ({_BRAND}) order by v desc, brand limit 5"),
    "q_top_within": ("select revenue by customer_region, segment limit revenue.top(2) within (customer_region)", f"{_F}, b as ({_RS}) select customer_region, segment, round(v, 4) as revenue from b qualify row_number() over (partition by customer_region order by v desc, segment) <= 2"),
    "q_top_of": ("select revenue by customer_region, segment limit revenue.top(2) of (customer_region)", f"{_F}, b as ({_RS}) select customer_region, segment, round(v, 4) as revenue from b where customer_region in (select customer_region from f group by 1 order by sum(amt) desc, customer_region limit 2)"),
    "q_top_of_within": ("select revenue by customer_region, segment, brand limit revenue.top(2) of (segment) within (customer_region)", f"{_F}, b as ({_RSB}), r as (select * from ({_RS}) qualify row_number() over (partition by customer_region order by v desc, segment) <= 2) select b.customer_region, b.segment, b.brand, round(b.v, 4) as revenue from b join r on r.customer_region = b.customer_region and r.segment = b.segment"),
    "q_top_intersect": ("select revenue by brand limit revenue.top(10), buyers.top(10)", f"{_F}, b as ({_BRAND}) select brand, round(v, 4) as revenue from b where brand in (select brand from b order by v desc, brand limit 10) and brand in (select brand from b order by b.b desc, brand limit 10)"),
    "q_percent_top": (
        "select revenue, revenue.percent, revenue.sum, revenue.total by brand limit revenue.top(5)",
        f"{_F}, b as ({_BRAND}), x as (select * from b order by v desc, brand limit 5) select brand, round(v, 4) as revenue, round(v / (select sum(v) from b), 4) as revenue__percent, round(sum(v) over (), 4) as revenue__sum, (select round(sum(v), 4) from b) as revenue__total from x",
    ),
    "q_filters_reach_totals": ("select revenue.percent within (customer_region) as pct where return_flag = 'R' by customer_region, segment limit revenue.bottom(2) within (customer_region)", f"{_F}, b as (select customer_region, segment, sum(amt) v from f where l_returnflag = 'R' group by 1, 2) select customer_region, segment, round(v / sum(v) over (partition by customer_region), 4) as pct from b qualify row_number() over (partition by customer_region order by v, segment) <= 2"),
    "q_scalar_fns": (
        "select order_count by power, priority_number, whole_price.step(3) as w, order_month_text, order_day.month as mm, filled, leap_year, is_past",
        "select power(ceil(abs(-o_totalprice) / 1000), 2) as power, case when o_orderpriority is null then 0 when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 2 end::bigint as priority_number, cast(floor((floor(o_totalprice)::bigint % 7) / 3) * 3 as bigint) as w, timestamp '1996-01-31 10:11:12' as order_month_text, month(o_orderdate) as mm, coalesce(o_orderstatus, 'none') as filled, (year(o_orderdate) % 4 = 0 and (year(o_orderdate) % 100 <> 0 or year(o_orderdate) % 400 = 0)) as leap_year, o_orderdate < now()::timestamp and not (o_orderdate >= today()) as is_past, count(*) as order_count from orders group by all",
    ),
    "q_docs": ("select n_docs, avg_chars by lang, source", "select lang, source, count(*) as n_docs, round(avg(n_chars), 4) as avg_chars from documents group by all"),
    "q_labels": ("select n_labels by lang, quality", "select d.lang, quality::bigint as quality, count(*) as n_labels from labels l left join documents d on d.doc_id = l.doc_id group by all"),
    "q_conversations": ("select n_conversations by role", "select role, count(distinct conv_id) as n_conversations from conversations group by 1"),
}


def _requested(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(project(spark, sf_dir).ql(text).df())


def q_fluent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request of q_filters_reach_totals, built step by step."""
    p = project(spark, sf_dir)
    found = p.select(p.m.revenue.percent(within=[p.d.customer_region]).name("pct")).by(p.d.customer_region, p.d.segment).where(p.d.return_flag == "R")
    return rounded(found.limit(p.m.revenue.bottom(2, within=[p.d.customer_region])).df())


def q_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = project(spark, sf_dir)
    wide = p.pivot("revenue").rows("brand").columns("return_flag", "$").frame(["A / revenue", "N / revenue", "R / revenue"])
    return rounded(wide.toDF("brand", "a", "n", "r"))


def q_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part of the compatibility matrix; it needs no data."""
    return project(spark, sf_dir).describe().where(F.col("dimension").isin("brand", "segment", "event_type", "nation_u", "Year", "lang", "order_priority")).select("dimension", "revenue", "n_customers", "n_events", "n_docs", "metric_of_metric", "revenue_per_part")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _requested(text) for name, (text, _) in REQUESTS.items()} | {f.__name__: f for f in (q_fluent, q_pivot, q_describe)}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in REQUESTS.items()} | {
    "q_fluent": REQUESTS["q_filters_reach_totals"][1],
    # Read off the model: what lies on a metric's table or on the tables that its foreign keys lead to.
    "q_describe": """select * from (values ('order_priority', '+', null, null, null, '+', null), ('segment', '+', '+', '+', null, '+', null), ('brand', '+', null, null, null, '+', '+'),
      ('event_type', null, null, '+', null, null, null), ('lang', null, null, null, '+', null, null), ('nation_u', null, '+', null, null, null, null), ('Year', '+', null, '+', null, '+', null)
    ) as t(dimension, revenue, n_customers, n_events, n_docs, metric_of_metric, revenue_per_part)""",
    "q_pivot": f"{_F} select brand, {', '.join(f'''round(sum(amt) filter (where l_returnflag = '{x.upper()}'), 4) as {x}''' for x in 'anr')} from f group by 1",
}
