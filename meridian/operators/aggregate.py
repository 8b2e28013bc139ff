"""Aggregation of measures at one level of detail, drill-across merging and top-N selection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import MissingQueryDimensionError
from ..functions.expressions import any_of, filtered_aggregates
from ..functions.transforms import applied
from ..model import GENERIC_TIME, Measure, Model, Place
from ..plans.request import Dimension
from ..plans.syntax import call, literal
from ..sources.tables import Catalog
from .anchor import Anchor


def place_of(model: Model, measure: Measure, dimension_id: str) -> Place:
    """Where a measure's table finds a dimension; a built-in time dimension is the measure's own time."""
    if dimension_id in GENERIC_TIME:
        if dimension_id not in model.time_dimensions(measure.id):
            raise MissingQueryDimensionError(f"{measure.id} has no {dimension_id}")
        return model.time_place(measure)
    found = model.places(measure.table).get(dimension_id)
    if found is None:
        raise MissingQueryDimensionError(f"{dimension_id} can't be told of {measure.id}, which is on {measure.table}")
    return found


def dimension_column(anchor: Anchor, measure: Measure, d: Dimension) -> Column:
    place = place_of(anchor.model, measure, d.id)
    tree = anchor.model.dimension_tree(place)
    if d.id in GENERIC_TIME:
        tree = call("datetrunc", literal(GENERIC_TIME[d.id]), tree)
    return applied(anchor.column(tree).cast(place.dimension.type.spark), d.transforms)


@dataclass(frozen=True)
class Names:
    """Internal column names of a request's dimensions and measures."""

    dimensions: tuple[tuple[Dimension, str], ...]

    @property
    def columns(self) -> list[str]:
        return [n for _, n in self.dimensions]


def measure_name(measure: str) -> str:
    return f"m#{measure}"


def grouped(model: Model, catalog: Catalog, measures: list[str], names: Names, filters: tuple[Dimension, ...]) -> DataFrame:
    """All measures of one anchor table in one aggregation.

    Filters of single measures become conditions inside their aggregates. Where every measure has one, rows of none are
    left out before; and a measure is null in groups where no row passed its filter."""
    all_measures = [model.measures[m] for m in measures]
    lead = all_measures[0]
    anchor = Anchor(model, catalog, lead.table)
    by = [dimension_column(anchor, lead, d).alias(n) for d, n in names.dimensions]
    conditions = [dimension_column(anchor, lead, f) for f in filters]
    values, own = [], []
    for m in all_measures:
        tree = model.measure_tree(m)
        if m.filter is not None:
            condition = model.row_tree(m.filter, m.table)
            own.append(anchor.column(condition))
            tree = filtered_aggregates(tree, condition)
        value = anchor.column(tree)
        if m.filter is not None and by:
            value = F.when(anchor.column(call("count", call("if", condition, literal(1)))) > 0, value)
        values.append(value.cast(m.type.spark).alias(measure_name(m.id)))
    anchor.filter_table()
    anchor.where(conditions)
    if len(own) == len(values):
        anchor.where([any_of(own)])
    return anchor.frame.groupBy(*by).agg(*values)


def listing(model: Model, catalog: Catalog, names: Names, filters: tuple[Dimension, ...]) -> DataFrame:
    """The distinct values of the dimensions in rows that pass the filters: on the table that reaches them all by the
    fewest relations, the first of such tables in the model's order."""
    wanted = [*(d for d, _ in names.dimensions), *filters]
    lengths = {}
    for table in model.tables:
        places = model.places(table)
        if all(d.id in places for d in wanted):
            lengths[table] = sum(len(places[d.id].path) for d in wanted)
    if not lengths:
        raise MissingQueryDimensionError(f"no table can tell of all of {', '.join(d.id for d in wanted)}")
    anchor = Anchor(model, catalog, min(lengths, key=lengths.get))
    places = model.places(anchor.table)
    column = lambda d: applied(anchor.dimension(places[d.id]), d.transforms)
    by, conditions = [column(d).alias(n) for d, n in names.dimensions], [column(f) for f in filters]
    anchor.filter_table()
    anchor.where(conditions)
    return anchor.frame.select(*by).distinct()


def merged(frames: list[DataFrame], names: Names) -> DataFrame:
    """Drill-across: rows of equal dimensions side by side, nulls being equal, with one shuffle for any number of frames."""
    if len(frames) == 1:
        return frames[0]
    if not names.columns:
        whole = frames[0]
        for f in frames[1:]:
            whole = whole.crossJoin(F.broadcast(f))  # each is one row
        return whole
    together = frames[0]
    for f in frames[1:]:
        together = together.unionByName(f, allowMissingColumns=True)
    values = [c for c in together.columns if c not in names.columns]
    return together.groupBy(*names.columns).agg(*(F.max(c).alias(c) for c in values))


def aggregated(model: Model, catalog: Catalog, measures: list[str], names: Names, filters: tuple[Dimension, ...]) -> DataFrame:
    """Every measure on its own table, by the dimensions, merged. Measures share an aggregation where they share the
    table and, for built-in time dimensions, the time."""
    if not measures:
        return listing(model, catalog, names, filters)
    timed = any(d.id in GENERIC_TIME for d in (*(d for d, _ in names.dimensions), *filters))
    groups: dict[tuple, list[str]] = {}
    for m in dict.fromkeys(measures):
        found = model.measures[m]
        groups.setdefault((found.table, found.time if timed else None), []).append(m)
    return merged([grouped(model, catalog, g, names, filters) for g in groups.values()], names)


def shared(frame: DataFrame) -> DataFrame:
    """The same rows behind a generator, through which Spark prunes no columns: branches that start here are equal below
    it, so the shuffle there is run once and reused."""
    return frame.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in frame.columns)))))


def at_level(detail: DataFrame, coarse: DataFrame, on: list[str]) -> DataFrame:
    """detail with the columns of coarse beside each row: by the level's columns, nulls being equal; a level without
    columns is one row."""
    if not on:
        return detail.crossJoin(F.broadcast(coarse))
    right = coarse.withColumnsRenamed({c: f"{c}#level" for c in on})
    condition = [F.col(f"`{c}`").eqNullSafe(F.col(f"`{c}#level`")) for c in on]
    return detail.join(right, condition, "left").drop(*(f"{c}#level" for c in on))


def _ranked(value: Column, by: list[str], descending: bool) -> list[Column]:
    """Order of ranking: by value with nulls last, then by all dimensions."""
    first = value.desc_nulls_last() if descending else value.asc_nulls_last()
    return [first, *(F.col(f"`{c}`").asc_nulls_first() for c in by)]


def top(frame: DataFrame, value: Column, n: int, by: list[str], within: list[str], descending: bool) -> DataFrame:
    """The n first rows in each group of `within`. Without one it is a limit, which Spark takes from each partition
    before it merges; with one, a window whose rank is cut before the shuffle."""
    order = _ranked(value, by, descending)
    if not within:
        return frame.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*(F.col(f"`{c}`") for c in within)).orderBy(*order))
    return frame.withColumn("rank#", rank).where(F.col("rank#") <= n).drop("rank#")


def among(frame: DataFrame, tuples: DataFrame, on: list[str]) -> DataFrame:
    """Rows of frame whose dimensions are among the tuples, nulls being equal."""
    if not on:
        return frame
    right = tuples.select(*(F.col(f"`{c}`").alias(f"{c}#kept") for c in on)).distinct()
    return frame.join(right, [F.col(f"`{c}`").eqNullSafe(F.col(f"`{c}#kept`")) for c in on], "left_semi")
