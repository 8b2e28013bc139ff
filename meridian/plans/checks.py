"""Whether a model can answer a request."""

from __future__ import annotations

from ..errors import DuplicateColumnError, MissingQueryDimensionError, MissingQueryMetricError, MissingTransformError, TransformChainError, TransformDimensionError, TransformTypeError
from ..functions.transforms import type_after
from ..model import GENERIC_TIME, Model
from ..types import Type
from .request import Dimension, Metric, Query


def _start(model: Model, d: Dimension) -> Type:
    if d.id in GENERIC_TIME:
        return Type("datetime", GENERIC_TIME[d.id])
    if d.id in model.unions:
        return model.unions[d.id].type
    if d.id in model.dimensions:
        return model.dimensions[d.id].type
    raise MissingQueryDimensionError(f"there is no dimension {d.id}")


def _table_transform(m: Metric, allowed: tuple[str, ...]) -> None:
    if len(m.transforms) > 1:
        raise TransformChainError(f"{m.render()}: a metric takes one transform")
    for t in m.transforms:
        if t.id not in allowed:
            raise MissingTransformError(f"{m.render()}: {t.id} isn't one of {', '.join(allowed)}")
        n = 1 if t.id in ("top", "bottom") else 0
        if len(t.args) != n or n and (isinstance(t.args[0], bool) or not isinstance(t.args[0], int) or t.args[0] < 0):
            raise TransformTypeError(f"{m.render()}: {t.id} takes {'a number of rows' if n else 'no arguments'}")


def check(model: Model, query: Query) -> None:
    from .compiler import LIMITING, SELECTED

    metrics = (*query.metrics, *query.limits)
    if not query.metrics and not query.dimensions:
        raise MissingQueryMetricError("a request needs a metric or a dimension")
    for m in metrics:
        if m.id not in model.metrics:
            raise MissingQueryMetricError(f"there is no metric {m.id}")
    for m in query.metrics:
        _table_transform(m, SELECTED)
    for m in query.limits:
        _table_transform(m, LIMITING)
        if not m.transforms:
            raise MissingTransformError(f"limit {m.render()} needs top or bottom")
    scopes = [(m, d) for m in metrics for t in m.transforms for d in (*t.of, *t.within)]
    for d in (*query.dimensions, *query.filters, *(d for _, d in scopes)):
        type_after(_start(model, d), d.transforms)
    for d in query.filters:
        if type_after(_start(model, d), d.transforms).name != "bool":
            raise TransformTypeError(f"{d.render()} isn't true or false")
    asked = {d.key for d in query.dimensions}
    for m, d in scopes:
        if d.key not in asked:
            raise TransformDimensionError(f"{m.render()}: the request isn't by {d.render()}")
    for m in metrics:
        for measure in model.measures_of(m.id):
            known = {*model.places(model.measures[measure].table), *model.time_dimensions(measure)}
            for d in (*query.dimensions, *query.filters):
                if d.id not in known:
                    raise MissingQueryDimensionError(f"{d.id} can't be told of {measure}, which is on {model.measures[measure].table}")
    names = [c.name for c in (*query.dimensions, *query.metrics)]
    for name in names:
        if names.count(name) > 1:
            raise DuplicateColumnError(f"two columns are named {name}")
