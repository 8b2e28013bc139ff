"""A small project to try things on: sales of a few bookshops, made by rule."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

SHOPS = (("Harbour", "North"), ("Market", "North"), ("Station", "South"))
BOOKS = (("Atlas", "reference", 40.0), ("Primer", "school", 12.5), ("Novel", "fiction", 15.0), ("Sequel", "fiction", 17.5))

MODEL = {
    "name": "bookshops",
    "tables": {
        "sales": {
            "related": {"shop": {"table": "shops", "foreign_key": "shop_id"}, "book": {"table": "books", "foreign_key": "book_id"}},
            "dimensions": {"sold_on": {"type": "date", "expr": "sold_on"}, "gift": {"type": "bool", "expr": "gift"}},
            "measures": {
                "takings": {"expr": "sum(copies * book.price)", "time": "sold_on", "format": "currency"}, "copies_sold": {"expr": "sum(copies)", "type": "int", "time": "sold_on"},
                "gifts": {"expr": "$copies_sold", "type": "int", "filter": ":gift"}, "titles": {"expr": "countd(book_id)", "type": "int"},
            },
        },
        "shops": {"primary_key": "id", "dimensions": {"shop": {"type": "str", "expr": "name"}, "side": {"type": "str", "expr": "side"}, "size_class": {"type": "int", "expr": "$takings // 1000"}}},
        "books": {"primary_key": "id", "dimensions": {"title": {"type": "str", "expr": "title"}, "genre": {"type": "str", "expr": "genre"}}, "measures": {"listed": {"expr": "count()", "type": "int"}}},
    },
    "metrics": {"price_paid": {"expr": "$takings / $copies_sold", "format": "currency"}, "gift_share": {"expr": "$gifts / $copies_sold", "format": "percent"}},
}


def frames(spark: SparkSession) -> dict[str, DataFrame]:
    """The tables: 180 sales over the first half of 2024."""
    sales = [(i, i % 7 % 3, i * i % 4, dt.date(2024, 1, 1) + dt.timedelta(days=i), 1 + i % 5, i % 6 == 0) for i in range(180)]
    return {
        "sales": spark.createDataFrame(sales, "id long, shop_id long, book_id long, sold_on date, copies long, gift boolean"),
        "shops": spark.createDataFrame([(i, *x) for i, x in enumerate(SHOPS)], "id long, name string, side string"),
        "books": spark.createDataFrame([(i, *x) for i, x in enumerate(BOOKS)], "id long, title string, genre string, price double"),
    }
