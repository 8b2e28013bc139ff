"""From a request to one lazy DataFrame.

Phases: measures are aggregated and merged; totals at coarser levels come beside them; top-N filters keep rows; sums over
the rows that are left are windows; at last columns are named, typed and ordered. Nothing runs before the caller acts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import TransformChainError
from ..functions.expressions import column_of
from ..functions.transforms import type_after
from ..model import GENERIC_TIME, Model
from ..operators.aggregate import Names, aggregated, among, at_level, measure_name, shared, top
from ..sources.tables import Catalog
from ..types import Type
from .checks import check
from .request import Dimension, Metric, Query, Transform

#: Table transforms over the rows that are left, all that can be selected, and those that limit.
WINDOWED = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}
SELECTED, LIMITING = ("total", "percent", *WINDOWED), ("top", "bottom")


def dimension_type(model: Model, d: Dimension) -> Type:
    if d.id in GENERIC_TIME:
        start = Type("datetime", GENERIC_TIME[d.id])
    elif d.id in model.unions:
        start = model.unions[d.id].type
    else:
        start = model.dimensions[d.id].type
    return type_after(start, d.transforms)


def metric_type(model: Model, m: Metric) -> Type:
    made = {"percent": "float", "avg": "float", "count": "int"}.get(m.transforms[0].id) if m.transforms else None
    return Type(made) if made else model.metrics[m.id].type


def _distinct(dims) -> tuple[Dimension, ...]:
    return tuple(dict.fromkeys(d.key for d in dims))


class Compiler:
    def __init__(self, model: Model, catalog: Catalog, query: Query):
        self.model, self.catalog, self.query = model, catalog, query
        self.names = Names(tuple((d, f"d#{i}") for i, d in enumerate(_distinct(query.dimensions))))
        self.of = dict(self.names.dimensions)

    # -- levels ----------------------------------------------------------------------------------------------------

    def _columns(self, dims) -> list[str]:
        return [self.of[d] for d in _distinct(dims)]

    def _names(self, dims) -> Names:
        return Names(tuple((d, self.of[d]) for d in _distinct(dims)))

    def _value(self, metric: str) -> Column:
        """A metric over measure columns."""
        tree = self.model.metric_tree(self.model.metrics[metric])
        return column_of(tree, lambda n: F.col(f"`{measure_name(n.value)}`")).cast(self.model.metrics[metric].type.spark)

    def _level_of(self, t: Transform) -> list[tuple[Dimension, ...]]:
        """The levels a transform compares: one for a total, numerator and denominator for a percentage."""
        every = tuple(self.of)
        of, within = _distinct(t.of), _distinct(t.within)
        if t.id == "total":
            return [_distinct((*of, *within))]
        if of and within:
            return [_distinct((*of, *within)), within]
        if of:
            return [every, tuple(d for d in every if d not in of)]
        return [every, within]

    def _coarse(self, base: DataFrame, metric: str, level: tuple[Dimension, ...]) -> DataFrame:
        """The level's columns and the metric's measures at a coarser level, under the same filters.

        Measures of the rows there are whose groups' values add up are summed from these; others are aggregated again."""
        measures = self.model.measures_of(metric)
        functions = [self.model.total_function(m) for m in measures]
        if not all(functions) or not {measure_name(m) for m in measures} <= set(base.columns):
            return aggregated(self.model, self.catalog, measures, self._names(level), self.query.filters)
        parts = [getattr(F, f)(F.col(f"`{measure_name(m)}`")).alias(measure_name(m)) for m, f in zip(measures, functions, strict=True)]
        return base.groupBy(*(F.col(f"`{c}`") for c in self._columns(level))).agg(*parts)

    def _total(self, base: DataFrame, metric: str, level: tuple[Dimension, ...]) -> DataFrame:
        """(level's columns, value): a metric at a coarser level."""
        on = [F.col(f"`{c}`") for c in self._columns(level)]
        return self._coarse(base, metric, level).select(*on, self._value(metric).alias("value#"))

    # -- phases ----------------------------------------------------------------------------------------------------

    def frame(self) -> DataFrame:
        check(self.model, self.query)
        query, every = self.query, tuple(self.of)
        limits = [(m, m.transforms[0]) for m in query.limits]
        inline, apart = [], []
        for m, t in limits:
            by = _distinct((*t.of, *t.within)) if t.of else every
            (inline if set(by) == set(every) else apart).append((m, t, by))
        wanted = [*query.metrics, *(m for m, _, _ in inline)]
        measures = list(dict.fromkeys(x for m in wanted for x in self.model.measures_of(m.id)))
        base = aggregated(self.model, self.catalog, measures, self.names, query.filters)
        if self.names.columns and (len(limits) > 1 or apart or any(m.transforms for m in query.metrics)):
            base = shared(base)
        whole, columns = base, {}
        totals: dict[tuple[str, tuple[Dimension, ...]], str] = {}

        def at(metric: str, level: tuple[Dimension, ...]) -> Column:
            nonlocal whole
            if set(level) == set(every):
                return self._value(metric)
            key = (metric, tuple(sorted(level, key=repr)))
            if key not in totals:
                totals[key] = f"t#{len(totals)}"
                coarse = self._total(base, metric, level).withColumnRenamed("value#", totals[key])
                whole = at_level(whole, coarse, self._columns(level))
            return F.col(f"`{totals[key]}`")

        for m in query.metrics:
            if len(m.transforms) > 1:
                raise TransformChainError(f"{m.render()}: a metric takes one transform")
            t = m.transforms[0] if m.transforms else None
            if t is None or t.id in WINDOWED:
                columns[m.key] = self._value(m.id)
            elif t.id == "total":
                columns[m.key] = at(m.id, self._level_of(t)[0])
            else:
                above, below = (at(m.id, level).cast("double") for level in self._level_of(t))
                columns[m.key] = above / F.nullif(below, F.lit(0.0))
        named = {k: f"v#{i}" for i, k in enumerate(columns)}
        whole = self._limited(base, whole, inline, apart)
        whole = whole.select(*(F.col(f"`{c}`") for c in self.names.columns), *(c.alias(named[k]) for k, c in columns.items()))
        sums = {}
        for m in query.metrics:
            value = F.col(f"`{named[m.key]}`")
            if m.transforms and m.transforms[0].id in WINDOWED:
                t = m.transforms[0]
                over, value = self._columns((*t.of, *t.within)), WINDOWED[t.id](value)
                if over:
                    value = value.over(Window.partitionBy(*(F.col(f"`{c}`") for c in over)))
                else:
                    sums[m.key] = value.alias(f"{named[m.key]}#whole")
                    value = F.col(f"`{named[m.key]}#whole`")
            columns[m.key] = value
        if sums:  # over all rows: one row joined back, as a window without partitions would be one task
            whole = whole.crossJoin(F.broadcast(whole.agg(*sums.values())))
        out = [F.col(f"`{self.of[d.key]}`").cast(dimension_type(self.model, d).spark).alias(d.name) for d in query.dimensions]
        out += [columns[m.key].cast(metric_type(self.model, m).spark).alias(m.name) for m in query.metrics]
        result = whole.select(*out)
        return result.orderBy(*(F.col(f"`{d.name}`").asc_nulls_first() for d in query.dimensions)) if query.dimensions else result

    def _limited(self, base: DataFrame, whole: DataFrame, inline: list, apart: list) -> DataFrame:
        """Top-N filters, each computed from all rows; a row stays if it is in all of them."""
        every = self.names.columns
        if len(inline) == 1 and not apart:
            m, t, by = inline[0]
            return top(whole, self._value(m.id), int(t.args[0]), self._columns(by), self._columns(t.within), t.id == "top")
        kept = []
        for m, t, by in inline:
            kept.append((top(base, self._value(m.id), int(t.args[0]), self._columns(by), self._columns(t.within), t.id == "top"), every))
        for m, t, by in apart:
            coarse = self._coarse(base, m.id, by)
            kept.append((top(coarse, self._value(m.id), int(t.args[0]), self._columns(by), self._columns(t.within), t.id == "top"), self._columns(by)))
        return reduce(lambda frame, k: among(frame, *k), kept, whole)


def compiled(model: Model, catalog: Catalog, query: Query) -> DataFrame:
    return Compiler(model, catalog, query).frame()
