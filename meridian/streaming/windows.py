"""Metrics over a stream: the measures of one table in tumbling windows of its events' time.

An extension of the model to Structured Streaming. A measure's aggregate runs as it is, the stream standing for the
anchor table, with static tables joined along its relations; state is dropped once the watermark has passed a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.expressions import filtered_aggregates
from ..functions.transforms import applied
from ..model import Model
from ..operators.anchor import Anchor
from ..plans.request import Dimension
from ..sources.tables import Catalog


def windowed(model: Model, catalog: Catalog, stream: DataFrame, table: str, measures: list[str], time_column: str, length: str, late: str, by: tuple[Dimension, ...] = ()) -> DataFrame:
    """(window_start, window_end, dimensions, measures) of a stream of a table's rows."""
    for m in measures:
        if model.measures[m].table != table:
            raise QueryError(f"{m} isn't a measure of {table}")
        if any(n.kind == "call" and n.value == "countd" for n in model.measure_tree(model.measures[m]).walk()):
            raise QueryError(f"{m}: a stream can't count distinct values exactly")
    source = model.tables[table].source
    if not isinstance(source, str):
        raise QueryError("a stream stands for a table that is named by its source")
    ready = stream.withColumn(time_column, F.col(time_column).cast("timestamp")).withWatermark(time_column, late)
    anchor = Anchor(model, Catalog(catalog.spark, catalog.root, catalog.default_schema, {**catalog.frames, source: ready}), table)
    places = model.places(table)
    dims = [applied(anchor.dimension(places[d.id]), d.transforms).alias(d.name) for d in by]
    values = []
    for key in measures:
        m = model.measures[key]
        tree = model.measure_tree(m)
        if m.filter is not None:
            tree = filtered_aggregates(tree, model.row_tree(m.filter, m.table))
        values.append(anchor.column(tree).cast(m.type.spark).alias(key))
    anchor.filter_table()
    made = anchor.frame.groupBy(F.window(F.col(f"`{time_column.lower()}`"), length).alias("window"), *dims).agg(*values)
    return made.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(F.col(f"`{d.name}`") for d in by), *measures)
