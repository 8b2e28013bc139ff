"""One-line definitions for notebooks: tables, relations, dimensions, metrics and formats as text.

    table     orders[o_orderkey] { schema=sales table=orders }
    related   orders.customer = o_custkey -> customer.c_custkey
    dimension orders.order_date = o_orderdate ::date as "Order date"
    metric    orders.order_value = sum(o_totalprice) where :order_date is not null ::float { format=currency }
    format    revenue kind=currency currency=EUR
"""

from __future__ import annotations

from .errors import ShorthandSyntaxError
from .plans.syntax import Tokens, expression, unquoted
from .project import Project


def _tokens(text: str) -> Tokens:
    return Tokens(text, ShorthandSyntaxError)


def _value(t: Tokens) -> object:
    if t.peek() == ("mark", "{"):
        return _properties(t)
    kind, text = t.next()
    if kind in ("text", "quoted"):
        return unquoted(text)
    if kind == "name":
        return text
    if kind in ("int", "float"):
        return int(text) if kind == "int" else float(text)
    t.at -= 1
    return t.fail("expected a value")


def _pairs(t: Tokens) -> dict:
    found = {}
    while t.peek()[0] in ("name", "quoted") and t.peek(1) == ("mark", "="):
        key = t.name(quoted=True)
        t.need("=")
        found[key] = _value(t)
    return found


def _properties(t: Tokens) -> dict:
    t.need("{")
    found = _pairs(t)
    t.need("}")
    return found


def _scoped(t: Tokens, table: str | None) -> tuple[str | None, str]:
    name = t.name()
    if t.take("."):
        return name, t.name()
    return table, name


def _expression_text(t: Tokens) -> str:
    start = t.items[t.at][2]
    expression(t)
    return t.text[start : t.items[t.at - 1][3]]


def _type(t: Tokens) -> str | None:
    if not t.take("::"):
        return None
    name = t.name()
    return f"{name}:{t.name()}" if t.take(":") else name


def _tail(t: Tokens, made: dict) -> dict:
    if kind := _type(t):
        made["type"] = kind
    if t.take("as"):
        made["name"] = t.name(quoted=True)
    if t.peek() == ("mark", "{"):
        made |= _properties(t)
    return made


def _metric(t: Tokens, table: str | None) -> dict:
    table, key = _scoped(t, table)
    t.need("=")
    made: dict = {"expr": _expression_text(t)}
    if table:
        made["table"] = table
    if t.take("where"):
        made["filter"] = _expression_text(t)
    return {"metrics": {key: _tail(t, made)}}


def _dimension(t: Tokens, table: str | None) -> dict:
    table, key = _scoped(t, table)
    if table is None:
        t.fail("a dimension needs a table")
    t.need("=")
    made = _tail(t, {"expr": _expression_text(t)})
    if "type" not in made:
        t.fail("a dimension needs a type")
    return {"tables": {table: {"dimensions": {key: made}}}}


def _related(t: Tokens, table: str | None) -> dict:
    first = t.name(quoted=True)
    table, alias = (first, t.name(quoted=True)) if t.take(".") else (table, first)
    if table is None:
        t.fail("a relation needs a table")
    t.need("=")
    made = {"foreign_key": t.name(quoted=True)}
    t.need("->")
    made["table"] = t.name()
    if t.take("."):
        made["related_key"] = t.name(quoted=True)
    return {"tables": {table: {"related": {alias: made}}}}


def _format(t: Tokens) -> object:
    pairs = _pairs(t)
    return pairs or t.name()


def _merge(a: dict, b: dict) -> dict:
    from .project import merged_model

    return merged_model(a, b)


def parse_table(text: str) -> dict:
    """A table and, after it, lines that start with related, dimension, metric or format."""
    t = _tokens(text)
    key = t.name()
    made: dict = {}
    if t.take("["):
        made["primary_key"] = t.name(quoted=True)
        t.need("]")
    if t.peek() == ("mark", "{"):
        made["source"] = _properties(t)
    elif t.peek()[0] in ("name", "quoted") and not (t.word() in ("related", "dimension", "metric", "format") and t.peek(1)[0] != "end"):
        made["source"] = t.name(quoted=True)
    update: dict = {"tables": {key: {"source": key, **made}}}
    while not t.done():
        word = t.need("related", "dimension", "metric", "format")
        if word == "format":
            name = t.name()
            update = _merge(update, {"formats": {name: _format(t)}})
        else:
            update = _merge(update, {"related": _related, "dimension": _dimension, "metric": _metric}[word](t, key))
    return update


def _whole(text: str, part, *args) -> dict:
    t = _tokens(text)
    found = part(t, *args)
    t.finish()
    return found


def parse_metric(text: str) -> dict:
    return _whole(text, _metric, None)


def parse_dimension(text: str) -> dict:
    return _whole(text, _dimension, None)


def parse_related(text: str) -> dict:
    return _whole(text, _related, None)


def parse_format(text: str) -> object:
    return _whole(text, _format)


class Shorthand:
    """Applies definitions to a project: each is checked with the whole model before it counts."""

    def __init__(self, project: Project):
        self.project = project

    def _apply(self, update: dict) -> None:
        formats = update.pop("formats", {})
        self.project.update(update)
        for name, value in formats.items():
            self._set_format(name, value)

    def table(self, line: str, cell: str | None = None) -> None:
        update = parse_table(f"{line}\n{cell or ''}")
        for key, value in update["tables"].items():
            if key in self.project.data.get("tables", {}) and value.get("source") == key and "source" in self.project.data["tables"][key]:
                value.pop("source")
        self._apply(update)

    def metric(self, text: str) -> None:
        self._apply(parse_metric(text))

    def dimension(self, text: str) -> None:
        self._apply(parse_dimension(text))

    def related(self, text: str) -> None:
        self._apply(parse_related(text))

    def format(self, text: str) -> None:
        t = _tokens(text)
        name = t.name()
        value = _format(t)
        t.finish()
        self._set_format(name, value)

    def _set_format(self, name: str, value: object) -> None:
        data = self.project.data
        if name in data.get("metrics", {}):
            self.project.update({"metrics": {name: {"format": value}}})
            return
        for key, table in data.get("tables", {}).items():
            for kind in ("measures", "dimensions"):
                if name in table.get(kind, {}):
                    self.project.update({"tables": {key: {kind: {name: {"format": value}}}}})
                    return
        raise ShorthandSyntaxError(f"there is no calculation {name}")

    def ql(self, text: str):
        return self.project.ql(text)


def load_ipython_extension(shell) -> None:
    """%table, %related, %dimension, %metric, %format and %ql for the variable `project` of a notebook."""

    def magic(name: str):
        def run(line: str, cell: str | None = None):
            found = Shorthand(shell.user_ns["project"])
            if name == "table":
                return found.table(line, cell)
            return getattr(found, name)(f"{line}\n{cell or ''}".strip())

        return run

    for name in ("table", "related", "dimension", "metric", "format", "ql"):
        shell.register_magic_function(magic(name), "line_cell", name)
