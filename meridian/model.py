"""The semantic model: tables, relations, dimensions, measures and metrics, resolved and checked once.

Everything here runs on the driver. References are resolved into trees whose columns are paths from one anchor table;
what is left for Spark is to join along those paths and aggregate.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from . import errors as e
from .plans.syntax import Node, call, literal, parse
from .types import GRAINS, Type, coarser, type_of

AGGREGATES = {"sum", "avg", "min", "max", "count", "countd"}
#: Scalar functions by their least and most arguments.
FUNCTIONS = {
    "abs": (1, 1), "floor": (1, 1), "ceil": (1, 1), "coalesce": (1, None), "tointeger": (1, 1), "tofloat": (1, 1), "todate": (1, 1), "todatetime": (1, 1),
    "datetrunc": (2, 2), "datepart": (2, 2), "datediff": (3, 3), "now": (0, 0), "today": (0, 0), "if": (2, None),
}
OPERATORS = {"or", "and", "not", "gt", "ge", "lt", "le", "eq", "ne", "add", "sub", "mul", "div", "floordiv", "mod", "pow", "neg", "isnull", "in"}
#: Built-in time dimensions: each measure's own time, truncated. Time is to the second.
GENERIC_TIME = {"Time": "second"} | {g.capitalize(): g for g in GRAINS} | {"Date": "day"}


@dataclass
class Related:
    alias: str
    table: str
    foreign_key: str
    related_key: str


@dataclass
class Calculation:
    id: str
    table: str | None
    text: object
    type: Type
    name: str
    description: str | None = None
    format: object = None
    missing: object = None
    tree: Node = None  # as parsed

    @property
    def kind(self) -> str:
        return type(self).__name__.lower()


@dataclass
class Dimension(Calculation):
    union: str | None = None


@dataclass
class Measure(Calculation):
    filter: Node | None = None
    filter_text: str | None = None
    time: str | None = None


@dataclass
class Metric(Calculation):
    pass


@dataclass
class Union:
    id: str
    name: str
    type: Type
    description: str | None = None
    format: object = None


@dataclass
class Table:
    id: str
    source: object
    primary_key: str | None = None
    description: str | None = None
    related: dict[str, Related] = field(default_factory=dict)
    filters: list[Node] = field(default_factory=list)
    dimensions: dict[str, Dimension] = field(default_factory=dict)
    measures: dict[str, Measure] = field(default_factory=dict)


@dataclass(frozen=True)
class Place:
    """A dimension as an anchor table sees it: the aliases that lead to its table."""

    dimension: Dimension
    path: tuple[str, ...]


def _check_id(name: object, what: str) -> str:
    if not isinstance(name, str) or not re.fullmatch(r"[A-Za-z_]\w*", name) or name.startswith("__") or name[0].isupper():
        raise e.InvalidIDError(f"{what} {name!r} isn't a lower-case identifier")
    return name


def _parsed(text: object, of: str) -> Node:
    try:
        return parse(text)
    except e.ExpressionSyntaxError as error:
        raise e.ExpressionSyntaxError(f"{of}: {error}") from None


class Model:
    def __init__(self, config: dict):
        self.config = copy.deepcopy(config)
        self.name = config.get("name", "")
        self.description = config.get("description")
        self.locale, self.currency = config.get("locale", "en_US"), config.get("currency", "USD")
        self.unions: dict[str, Union] = {}
        self.tables: dict[str, Table] = {}
        self.dimensions: dict[str, Dimension] = {}
        self.measures: dict[str, Measure] = {}
        self.metrics: dict[str, Metric] = {}
        self._paths: dict[str, dict[str, tuple[str, ...]]] = {}
        self._load(self.config)
        self._check()

    # -- loading ---------------------------------------------------------------------------------------------------

    def _load(self, config: dict) -> None:
        for key, c in (config.get("unions") or {}).items():
            self.unions[_check_id(key, "union")] = Union(key, c.get("name", key), self._type(c.get("type"), key), c.get("description"), c.get("format"))
        tables, metrics = config.get("tables") or {}, config.get("metrics") or {}
        for key, c in tables.items():
            self.tables[_check_id(key, "table")] = Table(key, c.get("source", key), c.get("primary_key"), c.get("description"))
        for key, c in tables.items():
            self._load_table(self.tables[key], c)
        for key, c in metrics.items():
            self._load_metric(_check_id(key, "metric"), c)

    def _type(self, declared: object, of: str, default: str | None = None) -> Type:
        if declared is None and default is None:
            raise e.ModelError(f"{of} needs a type")
        try:
            return type_of(declared or default)
        except ValueError as error:
            raise e.ModelError(f"{of}: {error}") from None

    def _load_table(self, table: Table, c: dict) -> None:
        for alias, r in (c.get("related") or {}).items():
            target = r.get("table", alias)
            if target not in self.tables:
                raise e.MissingTableError(f"{table.id} is related to {target}, which isn't a table")
            key = r.get("related_key") or self.tables[target].primary_key
            if not key:
                raise e.MissingRelatedKeyError(f"{table.id}.{alias}: {target} has no primary key, so related_key is needed")
            table.related[_check_id(alias, "relation")] = Related(alias, target, r["foreign_key"], key)
        table.filters = [_parsed(f, f"filter of {table.id}") for f in c.get("filters") or []]
        for key, d in (c.get("dimensions") or {}).items():
            if _check_id(key, "dimension") in self.dimensions:
                raise e.DuplicateCalculationError(f"dimension {key} is on {self.dimensions[key].table} and on {table.id}")
            union = d.get("union")
            if union and union not in self.unions:
                raise e.MissingCalculationError(f"{table.id}.{key}: there is no union {union}")
            if key in self.unions:
                raise e.DuplicateCalculationError(f"{key} is a union and a dimension of {table.id}")
            made = Dimension(key, table.id, d["expr"], self._type(d.get("type"), key), d.get("name", key), d.get("description"), d.get("format"), d.get("missing"), _parsed(d["expr"], key), union)
            self.dimensions[key] = table.dimensions[key] = made
        for key, m in (c.get("measures") or {}).items():
            self._load_measure(table, _check_id(key, "measure"), m)
            self._add_metric(key, m, Node("measure", key))

    def _load_measure(self, table: Table, key: str, m: dict) -> None:
        if key in self.measures:
            raise e.DuplicateCalculationError(f"measure {key} is on {self.measures[key].table} and on {table.id}")
        condition = m.get("filter")
        self.measures[key] = table.measures[key] = Measure(
            key, table.id, m["expr"], self._type(m.get("type"), key, "float"), m.get("name", key), m.get("description"), m.get("format"), m.get("missing"),
            _parsed(m["expr"], key), _parsed(condition, f"filter of {key}") if condition is not None else None, condition, m.get("time"),
        )

    def _add_metric(self, key: str, m: dict, tree: Node) -> None:
        if key in self.metrics:
            raise e.DuplicateCalculationError(f"metric {key} is defined twice")
        self.metrics[key] = Metric(key, m.get("table"), m["expr"], self._type(m.get("type"), key, "float"), m.get("name", key), m.get("description"), m.get("format"), m.get("missing"), tree)

    def _load_metric(self, key: str, m: dict) -> None:
        table = m.get("table")
        if table is None:
            if m.get("time") or m.get("filter"):
                raise e.MissingMetricTableError(f"{key} has a time or a filter, so it needs a table")
            self._add_metric(key, m, _parsed(m["expr"], key))
            return
        if table not in self.tables:
            raise e.MissingMetricTableError(f"{key}: there is no table {table}")
        self._load_measure(self.tables[table], key, m)
        self._add_metric(key, m, Node("measure", key))

    # -- join graph ------------------------------------------------------------------------------------------------

    def join_paths(self, table: str) -> dict[str, tuple[str, ...]]:
        """Aliases that lead to every table with exactly one way to it; a direct relation wins over longer ways."""
        if table not in self._paths:
            ways: dict[str, list[tuple[str, ...]]] = {}

            def visit(at: str, path: tuple[str, ...], seen: frozenset[str]) -> None:
                for alias, r in self.tables[at].related.items():
                    if r.table not in seen:
                        ways.setdefault(r.table, []).append((*path, alias))
                        visit(r.table, (*path, alias), seen | {r.table})

            visit(table, (), frozenset({table}))
            found = {t: p[0] for t, p in ways.items() if len(p) == 1}
            direct: dict[str, list[str]] = {}
            for alias, r in self.tables[table].related.items():
                direct.setdefault(r.table, []).append(alias)
            found |= {t: (aliases[0],) for t, aliases in direct.items() if len(aliases) == 1}
            self._paths[table] = found
        return self._paths[table]

    def places(self, table: str) -> dict[str, Place]:
        """Every dimension that can be asked of a table: its own, those of reachable tables, and its unions."""
        found = {}
        for target, path in self.join_paths(table).items():
            if target != table:
                found |= {d.id: Place(d, path) for d in self.tables[target].dimensions.values()}
        own = self.tables[table].dimensions.values()
        return found | {d.id: Place(d, ()) for d in own} | {d.union: Place(d, ()) for d in own if d.union}

    def target(self, table: str, path: tuple[str, ...]) -> str:
        """The table at the end of a path of aliases."""
        for alias in path:
            if alias not in self.tables[table].related:
                raise e.InvalidReferenceError(f"{table} has no relation {alias}")
            table = self.tables[table].related[alias].table
        return table

    def measure_path(self, measure: str, host: str) -> tuple[str, ...]:
        """From the measure's table to a host table whose rows it can be grouped by."""
        home = self.measures[measure].table
        if home == host:
            return ()
        if host not in self.join_paths(home):
            raise e.MissingMeasureError(f"{host} can't be reached from {home}, the table of ${measure}")
        return self.join_paths(home)[host]

    # -- resolution ------------------------------------------------------------------------------------------------

    def row_tree(self, tree: Node, table: str, path: tuple[str, ...] = ()) -> Node:
        """A row expression of the table at a path from the anchor, with dimensions put in; measures stay as
        Node("level", (path, measure)): the measure for each row of that table."""

        def change(n: Node) -> Node | None:
            if n.kind == "column":
                return Node("column", (*path, *n.value))
            if n.kind == "dimension":
                place = self.places(table)[n.value]
                return self.dimension_tree(Place(place.dimension, (*path, *place.path)))
            if n.kind == "measure":
                return Node("level", (path, n.value))
            return None

        return tree.replaced(change)

    def dimension_tree(self, place: Place) -> Node:
        d = place.dimension
        tree = self.row_tree(d.tree, d.table, place.path)
        return call("coalesce", tree, literal(d.missing)) if d.missing is not None else tree

    def measure_tree(self, measure: Measure) -> Node:
        """Aggregate expression over the measure's own table, with dimensions and other measures put in."""

        def change(n: Node) -> Node | None:
            if n.kind == "dimension":
                return self.row_tree(n, measure.table)
            if n.kind == "measure":
                other = self.measures[n.value]
                tree = self.measure_tree(other)
                return call("coalesce", tree, literal(other.missing)) if other.missing is not None else tree
            return None

        return measure.tree.replaced(change)

    def metric_tree(self, metric: Metric) -> Node:
        """Expression over measures, with other metrics put in; its missing value is filled in last."""

        def change(n: Node) -> Node | None:
            if n.kind == "measure":
                if n.value in self.measures:
                    m = self.measures[n.value]
                    return call("coalesce", n, literal(m.missing)) if m.missing is not None else n
                return self.metric_tree(self.metrics[n.value])
            return None

        tree = metric.tree.replaced(change)
        return call("coalesce", tree, literal(metric.missing)) if metric.missing is not None else tree

    def measures_of(self, metric: str) -> list[str]:
        return list(dict.fromkeys(n.value for n in self.metric_tree(self.metrics[metric]).walk() if n.kind == "measure"))

    # -- what can be asked together --------------------------------------------------------------------------------

    def time_dimensions(self, measure: str) -> list[str]:
        """Built-in time dimensions of a measure: those its own time can be truncated to."""
        time = self.measures[measure].time
        if time is None:
            return []
        grains = coarser(self.time_place(self.measures[measure]).dimension.type.grain)
        return [g for g, grain in GENERIC_TIME.items() if g == "Time" or grain in grains]

    def time_place(self, measure: Measure) -> Place:
        return self.places(measure.table)[measure.time]

    def dimensions_of(self, metric: str) -> list[str]:
        """Dimensions (and unions) that all measures of a metric know."""
        sets = [set(self.places(self.measures[m].table)) for m in self.measures_of(metric)]
        return sorted(set.intersection(*sets)) if sets else []

    def time_dimensions_of(self, metric: str) -> list[str]:
        sets = [set(self.time_dimensions(m)) for m in self.measures_of(metric)]
        return [g for g in GENERIC_TIME if sets and all(g in s for s in sets)]

    def metrics_by(self, dimensions: list[str]) -> list[str]:
        """Metrics that can be asked by all of these dimensions."""
        return [m for m in self.metrics if set(dimensions) <= {*self.dimensions_of(m), *self.time_dimensions_of(m)}]

    def lineage(self, metric: str) -> list[dict]:
        """What a metric is made of: calculations and columns, with their parents."""
        rows: list[dict] = []

        def add(kind: str, key: str, parent: str | None, tree: Node | None, table: str | None) -> None:
            label = f"{kind}:{table}.{key}" if table else f"{kind}:{key}"
            rows.append({"id": label, "type": kind, "name": key, "table": table, "parent": parent})
            for n in tree.walk() if tree else ():
                if n.kind == "column":
                    at = self.target(table, n.value[:-1]) if table else None
                    add("column", n.value[-1], label, None, at)
                elif n.kind == "dimension":
                    d = self.places(table)[n.value].dimension
                    add("dimension", d.id, label, d.tree, d.table)
                elif n.kind == "measure":
                    if n.value in self.measures:
                        m = self.measures[n.value]
                        add("measure", m.id, label, m.tree, m.table)
                    else:
                        add("metric", n.value, label, self.metrics[n.value].tree, None)

        add("metric", metric, None, self.metrics[metric].tree, None)
        return list({(r["id"], r["parent"]): r for r in rows}.values())

    def currencies(self, names: list[str]) -> set[str]:
        """Currencies that the formats of these calculations show."""
        found = set()
        for name in names:
            c = self.metrics.get(name) or self.dimensions.get(name) or self.unions.get(name)
            fmt = {"kind": c.format} if isinstance(getattr(c, "format", None), str) else (getattr(c, "format", None) or {})
            if fmt.get("kind") == "currency":
                found.add(fmt.get("currency") or self.currency)
        return found

    # -- checks ----------------------------------------------------------------------------------------------------

    def _trees(self) -> Iterator[tuple[str, str, str | None, Node]]:
        """(what, id, table, tree) of all expressions."""
        for d in self.dimensions.values():
            yield "dimension", d.id, d.table, d.tree
        for m in self.measures.values():
            yield "measure", m.id, m.table, m.tree
            if m.filter is not None:
                yield "filter", f"filter of {m.id}", m.table, m.filter
        for t in self.tables.values():
            for f in t.filters:
                yield "filter", f"filter of {t.id}", t.id, f
        for m in self.metrics.values():
            yield "metric", m.id, None, m.tree

    def _check(self) -> None:
        for what, key, table, tree in self._trees():
            self._check_functions(key, tree)
            self._check_references(what, key, table, tree)
        self._check_circles()
        for what, key, table, tree in self._trees():
            if what == "measure":
                self._check_measure(self.measures[key])
            elif what != "metric":
                self._check_rows(key, table, tree)
        for m in self.measures.values():
            if m.time is not None:
                place = self.places(m.table).get(m.time)
                if place is None or place.dimension.type.name != "datetime":
                    raise e.MissingCalculationError(f"{m.id}: {m.time} isn't a time dimension that {m.table} knows")

    def _check_functions(self, key: str, tree: Node) -> None:
        for n in tree.walk():
            if n.kind == "argument":
                raise e.InvalidReferenceError(f"{key}: @ stands only in transforms")
            if n.kind == "call" and n.value not in OPERATORS:
                low, high = (0 if n.value == "count" else 1, 1) if n.value in AGGREGATES else FUNCTIONS.get(n.value, (None, None))
                if low is None:
                    raise e.UnknownFunctionError(f"{key}: there is no function {n.value}")
                if len(n.args) < low or high is not None and len(n.args) > high:
                    raise e.UnknownFunctionError(f"{key}: {n.value} doesn't take {len(n.args)} arguments")

    def _check_references(self, what: str, key: str, table: str | None, tree: Node) -> None:
        for n in tree.walk():
            if what == "metric":
                if n.kind in ("column", "dimension"):
                    raise e.InvalidReferenceError(f"metric {key} may only refer to metrics and measures")
                if n.kind == "measure" and n.value not in self.metrics:
                    raise e.MissingMeasureError(f"{key}: there is no metric ${n.value}")
                if n.kind == "call" and n.value in AGGREGATES:
                    raise e.InvalidReferenceError(f"metric {key} can't aggregate; a measure does")
            elif n.kind == "column":
                self.target(table, n.value[:-1])
            elif n.kind == "dimension" and n.value not in self.places(table):
                raise e.MissingDimensionError(f"{key}: {table} knows no dimension :{n.value}")
            elif n.kind == "measure":
                if what == "measure":
                    if n.value not in self.tables[table].measures:
                        raise e.MissingMeasureError(f"{key}: {table} has no measure ${n.value}")
                    if self.measures[n.value].filter is not None:
                        raise e.FilteredMeasureReferenceError(f"{key}: ${n.value} has a filter")
                else:
                    if n.value not in self.measures:
                        raise e.MissingMeasureError(f"{key}: there is no measure ${n.value}")
                    self.measure_path(n.value, table)
                    if not self.tables[table].primary_key:
                        raise e.MissingPrimaryKeyError(f"{key}: {table} needs a primary key for ${n.value}")

    def _check_circles(self) -> None:
        done: set[tuple[str, str]] = set()

        def after(kind: str, key: str) -> Iterator[tuple[str, str]]:
            if kind == "dimension":
                d = self.dimensions[key]
                trees = [(d.tree, d.table)]
            elif kind == "measure":
                m = self.measures[key]
                trees = [(t, m.table) for t in (m.tree, m.filter, *self.tables[m.table].filters) if t is not None]
            else:
                trees = [(self.metrics[key].tree, None)]
            for tree, table in trees:
                for n in tree.walk():
                    if n.kind == "dimension":
                        yield "dimension", self.places(table)[n.value].dimension.id
                    elif n.kind == "measure":
                        yield ("measure" if n.value in self.measures else "metric"), n.value

        def visit(at: tuple[str, str], trail: tuple[tuple[str, str], ...]) -> None:
            if at in trail:
                raise e.CircularReferenceError(" -> ".join(k for _, k in (*trail, at)))
            if at not in done:
                for to in after(*at):
                    visit(to, (*trail, at))
                done.add(at)

        for kind, keys in (("dimension", self.dimensions), ("measure", self.measures), ("metric", self.metrics)):
            for key in keys:
                visit((kind, key), ())

    def _check_rows(self, key: str, table: str, tree: Node) -> None:
        if any(n.kind == "call" and n.value in AGGREGATES for n in tree.walk()):
            raise e.AggregateDimensionError(f"{key} stands for single rows, so it can't aggregate but by a measure")

    def _check_measure(self, m: Measure) -> None:
        def kind(n: Node) -> str:
            """any, row or aggregate."""
            if n.kind in ("column", "dimension"):
                return "row"
            if n.kind == "measure":
                return "aggregate"
            kinds = {kind(a) for a in n.args}
            if n.kind == "call" and n.value in AGGREGATES:
                if "aggregate" in kinds:
                    raise e.NestedAggregateError(f"{m.id}: {n.value} of an aggregate")
                return "aggregate"
            if {"row", "aggregate"} <= kinds:
                raise e.MixedAggregationError(f"{m.id} mixes aggregates and single rows")
            return "aggregate" if "aggregate" in kinds else "row" if "row" in kinds else "any"

        if kind(m.tree) != "aggregate":
            raise e.NonAggregateMeasureError(f"{m.id} must aggregate")

    def total_function(self, measure: str) -> str | None:
        """The aggregate that makes totals of a measure from its groups' values, if there is one."""
        tree = self.measure_tree(self.measures[measure])
        if tree.kind == "call":
            return {"sum": "sum", "count": "sum", "min": "min", "max": "max"}.get(tree.value)
        return None
