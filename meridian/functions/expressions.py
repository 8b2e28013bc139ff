"""From expression trees to Spark columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnknownFunctionError
from ..plans.syntax import Node
from ..types import GRAINS

Leaf = Callable[[Node], Column]


def truncated(part: str, c: Column) -> Column:
    """The start of the part that holds c. Times have no zone here: dates and fields are taken and put together again, as
    date_trunc would go through the session's zone and its clock changes."""
    if part not in GRAINS:
        raise UnknownFunctionError(f"no part of time {part!r}")
    c = c.cast("timestamp_ntz")
    day = c.cast("date")
    if part in ("year", "quarter", "month", "week"):
        return F.trunc(day, part).cast("timestamp_ntz")
    fields = [F.hour(c), F.minute(c), F.floor(F.second(c))][: ("day", "hour", "minute", "second").index(part)]
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), *fields) if fields else day.cast("timestamp_ntz")


_PARTS = {
    "year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second,
    "dow": lambda c: F.weekday(c) + 1, "dayofweek": lambda c: F.weekday(c) + 1,
}


def part_of(part: str, c: Column) -> Column:
    """Monday is day 1 of a week and Sunday day 7; weeks are those of ISO 8601."""
    if part not in _PARTS:
        raise UnknownFunctionError(f"no part of time {part!r}")
    return _PARTS[part](c).cast("long")


def boundaries(part: str, a: Column, b: Column) -> Column:
    """How many boundaries of a part lie between a and b; negative if b comes first."""
    a, b = a.cast("timestamp_ntz"), b.cast("timestamp_ntz")
    months = lambda c: F.year(c).cast("long") * 12 + F.month(c)
    days = lambda x, y: F.datediff(y, x).cast("long")
    if part == "year":
        return F.year(b).cast("long") - F.year(a)
    if part == "quarter":
        return (F.year(b).cast("long") - F.year(a)) * 4 + F.quarter(b) - F.quarter(a)
    if part == "month":
        return months(b) - months(a)
    if part == "week":
        return F.floor(days(truncated("week", a), truncated("week", b)) / 7)
    count = days(a, b)
    for name, field, each in (("day", None, 1), ("hour", F.hour, 24), ("minute", F.minute, 60), ("second", F.second, 60)):
        if field is not None:
            count = count * each + field(b) - field(a)
        if part == name:
            return count.cast("long")
    raise UnknownFunctionError(f"no part of time {part!r}")


def chosen(args: list[Column]) -> Column:
    """if(c1, v1, c2, v2, ..., else); null without an else."""
    pairs, rest = args[: len(args) // 2 * 2], args[len(args) // 2 * 2 :]
    made = F
    for c, v in zip(pairs[::2], pairs[1::2], strict=True):
        made = made.when(c, v)
    return made.otherwise(rest[0]) if rest else made


def _quotient(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _floor_quotient(a: Column, b: Column) -> Column:
    """Exact for two whole numbers; Spark keeps the one case that the types ask for."""
    x, y = a.cast("long"), F.nullif(b.cast("long"), F.lit(0))
    down = ((x % y != 0) & ((x < 0) != (y < 0))).cast("long")
    return F.when(F.typeof(a).isin(*_WHOLE) & F.typeof(b).isin(*_WHOLE), F.call_function("div", x, y) - down).otherwise(F.floor(_quotient(a, b)))


_CALLS: dict[str, Callable[..., Column]] = {
    "or": lambda a, b: a | b, "and": lambda a, b: a & b, "not": lambda a: ~a, "isnull": lambda a: a.isNull(), "in": lambda a, *items: a.isin(*items),
    "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b,
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": _quotient, "floordiv": _floor_quotient,
    "mod": lambda a, b: a % F.nullif(b, F.lit(0)), "pow": F.pow, "neg": lambda a: -a,
    "abs": F.abs, "floor": F.floor, "ceil": F.ceil, "coalesce": F.coalesce, "tointeger": lambda a: a.cast("long"), "tofloat": lambda a: a.cast("double"),
    "todate": lambda a: a.cast("date").cast("timestamp_ntz"), "todatetime": lambda a: a.cast("timestamp_ntz"),
    "now": lambda: F.localtimestamp(), "today": lambda: F.current_date().cast("timestamp_ntz"), "if": lambda *args: chosen(list(args)),
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": lambda a=None: F.count(F.lit(1) if a is None else a), "countd": F.countDistinct,
}
_TIMED = {"datetrunc": truncated, "datepart": part_of, "datediff": boundaries}


def column_of(tree: Node, leaf: Leaf) -> Column:
    """The column of a tree; leaf gives those of all but literals and calls."""
    if tree.kind == "literal":
        return F.lit(tree.value)
    if tree.kind != "call":
        return leaf(tree)
    if tree.value in _TIMED:
        part, *rest = tree.args
        if part.kind != "literal" or not isinstance(part.value, str):
            raise UnknownFunctionError(f"{tree.value} takes the name of a part first")
        return _TIMED[tree.value](part.value.lower(), *(column_of(a, leaf) for a in rest))
    if tree.value not in _CALLS:
        raise UnknownFunctionError(f"there is no function {tree.value}")
    return _CALLS[tree.value](*(column_of(a, leaf) for a in tree.args))


def filtered_aggregates(tree: Node, condition: Node) -> Node:
    """An aggregate expression that takes only rows for which the condition holds."""
    from ..model import AGGREGATES

    def change(n: Node) -> Node | None:
        if n.kind == "call" and n.value in AGGREGATES:
            return Node("call", n.value, (Node("call", "if", (condition, n.args[0] if n.args else Node("literal", 1))),))
        return None

    return tree.replaced(change)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
