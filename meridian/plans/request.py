"""Requests: metrics by dimensions, with transforms; their names, their text form and the parser of that form."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..errors import QuerySyntaxError
from .syntax import Tokens


def written(value: object) -> str:
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int | float):
        return repr(value)
    text = value.isoformat(sep=" ") if hasattr(value, "isoformat") else str(value)
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _identifier(name: str) -> str:
    return name if name.isidentifier() else '"' + name.replace('"', '\\"') + '"'


@dataclass(frozen=True)
class Transform:
    id: str
    args: tuple = ()
    of: tuple[Dimension, ...] = ()
    within: tuple[Dimension, ...] = ()

    @property
    def suffix(self) -> str:
        parts = [self.id, *map(str, self.args)]
        return "_".join(parts) + "".join(f"_of_{d.name}" for d in self.of) + "".join(f"_within_{d.name}" for d in self.within)

    def render(self) -> str:
        text = f"{self.id}({', '.join(map(written, self.args))})"
        for word, dims in (("of", self.of), ("within", self.within)):
            if dims:
                text += f" {word} ({', '.join(d.render() for d in dims)})"
        return text


@dataclass(frozen=True)
class Calculation:
    id: str
    transforms: tuple[Transform, ...] = ()
    alias: str | None = None

    @property
    def generated_name(self) -> str:
        return f"{self.id}__{'_'.join(t.suffix for t in self.transforms)}" if self.transforms else self.id

    @property
    def name(self) -> str:
        return self.alias or self.generated_name

    @property
    def key(self) -> Calculation:
        """What it asks for, whatever it is called."""
        return replace(self, alias=None)

    def render(self) -> str:
        text = ".".join([_identifier(self.id), *(t.render() for t in self.transforms)])
        return f'{text} as "{self.alias}"' if self.alias else text

    def then(self, transform: Transform):
        return replace(self, transforms=(*self.transforms, transform))


class Dimension(Calculation):
    pass


class Metric(Calculation):
    pass


@dataclass(frozen=True)
class Query:
    metrics: tuple[Metric, ...]
    dimensions: tuple[Dimension, ...] = ()
    filters: tuple[Dimension, ...] = ()
    limits: tuple[Metric, ...] = ()

    def render(self) -> str:
        text = "select " + ", ".join(m.render() for m in self.metrics)
        for word, items in (("where", self.filters), ("by", self.dimensions), ("limit", self.limits)):
            if items:
                text += f" {word} " + ", ".join(i.render() for i in items)
        return text


#: Comparison marks of requests and the transforms they stand for.
_MARKS = {"=": "eq", "==": "eq", "!=": "ne", "<>": "ne", ">": "gt", ">=": "ge", "<": "lt", "<=": "le"}


def _transform(t: Tokens, table: bool) -> Transform:
    name, args = t.name(quoted=True).lower(), []
    if t.take("("):
        if not t.take(")"):
            args.append(t.constant())
            while t.take(","):
                args.append(t.constant())
            t.need(")")
    name = "invert" if name == "not" and not table else name
    scopes: dict[str, tuple[Dimension, ...]] = {}
    for word in ("of", "within") if table else ():
        if t.take(word):
            t.need("(")
            scopes[word] = tuple(_listed(t, dimension))
            t.need(")")
    return Transform(name, tuple(args), **scopes)


def _compared(t: Tokens) -> Transform | None:
    mark = t.take(*_MARKS)
    if mark:
        return Transform(_MARKS[mark], (t.constant(),))
    if t.take("is"):
        negated = bool(t.take("not"))
        t.need("null")
        return Transform("isnotnull" if negated else "isnull")
    negated = bool(t.take("not"))
    if t.take("in"):
        t.need("(")
        args = [t.constant()]
        while t.take(","):
            args.append(t.constant())
        t.need(")")
        return Transform("isnotin" if negated else "isin", tuple(args))
    return t.fail("expected in") if negated else None


def _listed(t: Tokens, item):
    yield item(t)
    while t.take(","):
        yield item(t)


def dimension(t: Tokens) -> Dimension:
    found = Dimension(t.name(quoted=True))
    while t.take("."):
        found = found.then(_transform(t, table=False))
    more = _compared(t)
    return found.then(more) if more else found


def metric(t: Tokens) -> Metric:
    found = Metric(t.name(quoted=True))
    while t.take("."):
        found = found.then(_transform(t, table=True))
    more = _compared(t)
    return found.then(more) if more else found


def _named(item):
    def parse(t: Tokens):
        found = item(t)
        return replace(found, alias=t.name(quoted=True)) if t.take("as") else found

    return parse


def parse_query(text: str) -> Query:
    t = Tokens(text, QuerySyntaxError)
    t.need("select")
    metrics = () if t.word() in ("where", "by", "group") and t.peek(1)[0] in ("name", "quoted") else tuple(_listed(t, _named(metric)))
    filters = tuple(_listed(t, dimension)) if t.take("where") else ()
    dims: tuple[Dimension, ...] = ()
    limits: tuple[Metric, ...] = ()
    if t.take("group"):
        t.need("by")
        dims = tuple(_listed(t, _named(dimension)))
    elif t.take("by"):
        dims = tuple(_listed(t, _named(dimension)))
    if dims and t.take("limit"):
        limits = tuple(_listed(t, metric))
    t.finish()
    return Query(metrics, dims, filters, limits)


def _one(item, text: str):
    t = Tokens(text, QuerySyntaxError)
    found = item(t)
    t.finish()
    return found


def parse_metric(text: str) -> Metric:
    return _one(_named(metric), text)


def parse_dimension(text: str) -> Dimension:
    return _one(_named(dimension), text)
