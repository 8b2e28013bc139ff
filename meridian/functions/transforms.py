"""Scalar transforms: columns to columns, with the types they take and give. More can be registered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import MissingTransformError, TransformTypeError
from ..plans.request import Transform
from ..types import GRAINS, Type
from .expressions import boundaries, part_of, truncated

ANY = ("bool", "int", "float", "str", "datetime")
ORDERED = ("datetime", "int", "float", "str")
NUMERIC = ("int", "float")
TIME = ("datetime",)


@dataclass(frozen=True)
class ScalarTransform:
    id: str
    takes: tuple[str, ...]
    column: Callable[..., Column]
    gives: Callable[[Type, tuple], Type]
    arguments: tuple[int, int | None] = (0, 0)


TRANSFORMS: dict[str, ScalarTransform] = {}


def register(transform: ScalarTransform) -> ScalarTransform:
    TRANSFORMS[transform.id] = transform
    return transform


def _fixed(name: str) -> Callable[[Type, tuple], Type]:
    return lambda *_: Type(name)


def _grained(*_args) -> Type:
    return Type("datetime", str(_args[1][0]).lower())


for _id, _column in {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v, "lt": lambda c, v: c < v, "le": lambda c, v: c <= v,
}.items():
    register(ScalarTransform(_id, (*ORDERED, "bool") if _id in ("eq", "ne") else ORDERED, _column, _fixed("bool"), (1, 1)))
for _id in ("invert", "not"):
    register(ScalarTransform(_id, ("bool",), lambda c: ~c, _fixed("bool")))
register(ScalarTransform("isnull", ANY, lambda c: c.isNull(), _fixed("bool")))
register(ScalarTransform("isnotnull", ANY, lambda c: c.isNotNull(), _fixed("bool")))
register(ScalarTransform("inrange", (*NUMERIC, "datetime"), lambda c, low, high: c.between(low, high), _fixed("bool"), (2, 2)))
register(ScalarTransform("isin", ORDERED, lambda c, *items: c.isin(*items), _fixed("bool"), (1, None)))
register(ScalarTransform("isnotin", ORDERED, lambda c, *items: ~c.isin(*items), _fixed("bool"), (1, None)))
register(ScalarTransform("last", TIME, lambda c, n, part: boundaries(str(part).lower(), c, F.localtimestamp()) <= n, _fixed("bool"), (2, 2)))
register(ScalarTransform("step", NUMERIC, lambda c, size: (F.floor(c / size) * size).cast("long"), _fixed("int"), (1, 1)))
register(ScalarTransform("datepart", TIME, lambda c, part: part_of(str(part).lower(), c), _fixed("int"), (1, 1)))
register(ScalarTransform("datetrunc", TIME, lambda c, part: truncated(str(part).lower(), c), _grained, (1, 1)))
register(ScalarTransform("date", TIME, lambda c: truncated("day", c), lambda *_: Type("datetime", "day")))
for _id in (*GRAINS, "dow", "dayofweek"):
    register(ScalarTransform(_id, TIME, lambda c, part=_id: part_of(part, c), _fixed("int")))


def found(transform: Transform) -> ScalarTransform:
    if transform.id not in TRANSFORMS:
        raise MissingTransformError(f"there is no transform {transform.id}")
    made = TRANSFORMS[transform.id]
    low, high = made.arguments
    if len(transform.args) < low or high is not None and len(transform.args) > high:
        raise TransformTypeError(f"{transform.id} doesn't take {len(transform.args)} arguments")
    return made


def type_after(start: Type, transforms: tuple[Transform, ...]) -> Type:
    """The type at the end of a chain, each link checked against the type before it."""
    for t in transforms:
        made = found(t)
        if start.name not in made.takes:
            raise TransformTypeError(f"{t.id} doesn't take {start.name}")
        start = made.gives(start, t.args)
    return start


def applied(c: Column, transforms: tuple[Transform, ...]) -> Column:
    for t in transforms:
        c = found(t).column(c, *t.args)
    return c
