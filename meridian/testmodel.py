"""A semantic model over the star schema of the test data."""

MODEL = {
    "name": "sales",
    "unions": {"nation_u": {"name": "Nation", "type": "str"}},
    "tables": {
        "lineitem": {
            "source": "lineitem",
            "related": {
                "order": {"table": "orders", "foreign_key": "l_orderkey"}, "part": {"table": "part", "foreign_key": "l_partkey"},
                "supplier": {"table": "supplier", "foreign_key": "l_suppkey"},
            },
            "dimensions": {
                "ship_date": {"type": "date", "expr": "l_shipdate"}, "return_flag": {"type": "str", "expr": "l_returnflag"}, "line_status": {"type": "str", "expr": "l_linestatus"},
                "quantity_bin": {"type": "int", "expr": "l_quantity // 10 * 10"}, "is_discounted": {"type": "bool", "expr": "l_discount > 0.05"},
                "quantity": {"type": "float", "expr": "l_quantity"},
            },
            "measures": {
                "revenue": {"expr": "sum(l_extendedprice * (1 - l_discount))", "missing": 0, "time": "ship_date", "format": "currency"},
                "items_sold": {"expr": "sum(l_quantity)", "time": "ship_date"}, "line_count": {"expr": "count()", "type": "int", "time": "ship_date"},
                "buyers": {"expr": "countd(order.o_custkey)", "type": "int", "time": "ship_date"}, "avg_discount": {"expr": "avg(l_discount)"},
                "min_price": {"expr": "min(l_extendedprice)"}, "max_price": {"expr": "max(l_extendedprice)"}, "last_ship": {"expr": "max(l_shipdate)", "type": "datetime"},
                "returned_revenue": {"expr": "$revenue", "filter": "l_returnflag = 'R'"}, "counted_flags": {"expr": "count(l_returnflag)", "type": "int"},
                "urgent_lines": {"expr": "count(case when order.o_orderpriority = '1-URGENT' then 1 end)", "type": "int"},
                "revenue_per_line": {"expr": "$revenue / $line_count"}, "asian_revenue": {"expr": "$revenue", "filter": ":customer_region in ('ASIA')"},
            },
        },
        "lineitem_returned": {
            "source": "lineitem", "filters": ["l_returnflag = 'R'"], "related": {"returned_part": {"table": "part", "foreign_key": "l_partkey"}},
            "measures": {"returned_total": {"expr": "sum(l_extendedprice * (1 - l_discount))"}},
        },
        "orders": {
            "source": "orders", "primary_key": "o_orderkey", "related": {"customer": {"table": "customer", "foreign_key": "o_custkey"}},
            "dimensions": {
                "order_date": {"type": "date", "expr": "o_orderdate"}, "order_status": {"type": "str", "expr": "o_orderstatus"}, "order_priority": {"type": "str", "expr": "o_orderpriority"},
                "order_value_bin": {"type": "int", "expr": "o_totalprice // 50000 * 50000"}, "order_revenue": {"type": "float", "expr": "$revenue"},
                "order_lines": {"type": "int", "expr": "$line_count", "missing": 0},
                **{f"order_{p}s_in": {"type": "int", "expr": f"datediff('{p}', todatetime('1995-06-17 12:00:00'), o_orderdate)"} for p in ("year", "quarter", "month", "week", "day")},
                "cohort_month": {"type": "int", "expr": "datediff('month', :customer_first_order, :order_date)"},
                "leap_year": {"type": "bool", "expr": "if(:order_year % 400 = 0, TRUE, :order_year % 100 = 0, FALSE, :order_year % 4 = 0)"},
                "order_year": {"type": "int", "expr": "datepart('year', o_orderdate)"},
                "power": {"type": "float", "expr": "ceil(abs(-o_totalprice) / 1000) ** 2"}, "priority_number": {"type": "int", "expr": "case when o_orderpriority is null then 0 when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 2 end"},
                "order_month_text": {"type": "datetime", "expr": "todatetime('1996-01-31 10:11:12')"}, "whole_price": {"type": "int", "expr": "tointeger(floor(tofloat(o_totalprice)) % 7)"},
                "order_day": {"type": "date", "expr": "todate(o_orderdate)"}, "filled": {"type": "str", "expr": "coalesce(o_orderstatus, 'none')"},
                "is_past": {"type": "bool", "expr": "o_orderdate < now() and not (o_orderdate >= today())"},
            },
            "measures": {
                "order_count": {"expr": "count()", "type": "int", "time": "order_date"}, "order_value": {"expr": "sum(o_totalprice)", "time": "order_date"},
                "first_order": {"expr": "min(o_orderdate)", "type": "datetime"},
            },
        },
        "customer": {
            "source": "customer", "primary_key": "c_custkey", "related": {"nation": {"table": "nation", "foreign_key": "c_nationkey"}},
            "dimensions": {
                "segment": {"type": "str", "expr": "c_mktsegment"}, "customer_nation": {"type": "str", "expr": "nation.n_name", "union": "nation_u"},
                "customer_region": {"type": "str", "expr": "nation.region.r_name"}, "customer_order_value": {"type": "float", "expr": "$order_value"},
                "customer_value_bin": {"type": "int", "expr": ":customer_order_value // 100000 * 100000"}, "customer_first_order": {"type": "datetime", "expr": "$first_order"},
            },
            "measures": {"n_customers": {"expr": "count()", "type": "int"}, "avg_balance": {"expr": "avg(c_acctbal)"}},
        },
        "supplier": {
            "source": "supplier", "primary_key": "s_suppkey", "related": {"nation": {"table": "nation", "foreign_key": "s_nationkey"}},
            "dimensions": {"supplier_nation": {"type": "str", "expr": "nation.n_name", "union": "nation_u"}, "supplier_region": {"type": "str", "expr": "nation.region.r_name"}},
            "measures": {"n_suppliers": {"expr": "count()", "type": "int"}},
        },
        "part": {
            "source": "part", "primary_key": "p_partkey",
            "dimensions": {"brand": {"type": "str", "expr": "p_brand"}, "part_type": {"type": "str", "expr": "p_type"}, "part_size": {"type": "int", "expr": "p_size"}},
            "measures": {"n_parts": {"expr": "count()", "type": "int"}, "avg_retail": {"expr": "avg(p_retailprice)"}},
        },
        "nation": {"source": "nation", "primary_key": "n_nationkey", "related": {"region": {"table": "region", "foreign_key": "n_regionkey"}}, "dimensions": {"nation_name": {"type": "str", "expr": "n_name"}}},
        "region": {"source": "region", "primary_key": "r_regionkey", "dimensions": {"region_name": {"type": "str", "expr": "r_name"}}},
        "events": {
            "source": "events", "primary_key": "event_id", "related": {"user": {"table": "customer", "foreign_key": "user_id"}},
            "dimensions": {
                "event_type": {"type": "str", "expr": "event_type"}, "event_ts": {"type": "datetime", "expr": "ts"},
                **{f"{p}s_in": {"type": "int", "expr": f"datediff('{p}', todatetime('2023-12-31 23:59:59'), ts)"} for p in ("year", "quarter", "month", "week", "day", "hour", "minute", "second")},
            },
            "measures": {"n_events": {"expr": "count()", "type": "int", "time": "event_ts"}, "event_value": {"expr": "sum(value)", "time": "event_ts"}, "active_users": {"expr": "countd(user_id)", "type": "int", "time": "event_ts"}},
        },
        "documents": {
            "source": "documents", "primary_key": "doc_id",
            "dimensions": {"lang": {"type": "str", "expr": "lang"}, "source": {"type": "str", "expr": "source"}, "n_chars": {"type": "int", "expr": "n_chars"}},
            "measures": {"n_docs": {"expr": "count()", "type": "int"}, "avg_chars": {"expr": "avg(n_chars)"}},
        },
        "labels": {
            "source": "labels", "related": {"document": {"table": "documents", "foreign_key": "doc_id"}},
            "dimensions": {"quality": {"type": "int", "expr": "quality"}}, "measures": {"n_labels": {"expr": "count()", "type": "int"}},
        },
        "conversations": {"source": "conversations", "dimensions": {"role": {"type": "str", "expr": "role"}}, "measures": {"n_conversations": {"expr": "countd(conv_id)", "type": "int"}}},
    },
    "metrics": {
        "revenue_per_buyer": {"expr": "$revenue / $buyers"}, "avg_order_value": {"expr": "$order_value / $order_count", "format": "currency"},
        "return_rate": {"expr": "$returned_revenue / $revenue", "format": "percent"}, "revenue_per_part": {"expr": "$revenue / $n_parts"},
        "metric_of_metric": {"expr": "$revenue_per_buyer / 100"}, "parts_listed": {"expr": "count()", "type": "int", "table": "part"},
        "orders_or_zero": {"expr": "$order_count", "missing": 0, "type": "int"},
    },
}
