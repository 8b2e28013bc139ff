"""The API: a project is a model with a catalog; analyses are built step by step and give Spark DataFrames."""

from __future__ import annotations

import copy
import time
from dataclasses import dataclass, replace
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import example
from .errors import ProjectError
from .formatting import Formatter, shown
from .model import GENERIC_TIME, Model
from .plans.compiler import compiled, dimension_type, metric_type
from .plans.request import Dimension, Metric, Query, Transform, parse_dimension, parse_metric, parse_query
from .shipping import ship
from .sources.files import ModelFiles, load_profile, load_project, scaffold
from .sources.tables import Catalog


class Request:
    """A metric or dimension being asked for; comparisons and calls of transforms make new ones."""

    def __init__(self, item: Metric | Dimension):
        self.item = item

    def _with(self, name: str, *args, of=(), within=()) -> Request:
        scope = lambda dims: tuple(_dimension(d) for d in (dims if isinstance(dims, list | tuple) else [dims]))
        name = "invert" if name == "not" else name.lower()
        return Request(self.item.then(Transform(name, tuple(args), scope(of), scope(within))))

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return lambda *args, of=(), within=(): self._with(name, *args, of=of, within=within)

    def name(self, alias: str) -> Request:
        return Request(replace(self.item, alias=alias))

    def render(self) -> str:
        return self.item.render()

    def __eq__(self, other):
        return self._with("eq", other)

    def __ne__(self, other):
        return self._with("ne", other)

    def __gt__(self, other):
        return self._with("gt", other)

    def __ge__(self, other):
        return self._with("ge", other)

    def __lt__(self, other):
        return self._with("lt", other)

    def __le__(self, other):
        return self._with("le", other)

    def __invert__(self):
        return self._with("invert")

    __hash__ = None


class Names:
    """Attribute access to metrics or dimensions: project.m.revenue, project.d.segment."""

    def __init__(self, kind: type, known):
        self._kind, self._known = kind, known

    def __getattr__(self, name: str) -> Request:
        if name.startswith("__") or name not in self._known():
            raise AttributeError(name)
        return Request(self._kind(name))

    def __getitem__(self, name: str) -> Request:
        if name not in self._known():
            raise KeyError(name)
        return Request(self._kind(name))

    def __dir__(self):
        return sorted(self._known())


def _dimension(d) -> Dimension:
    return d.item if isinstance(d, Request) else d if isinstance(d, Dimension) else parse_dimension(d)


def _metric(m) -> Metric:
    return m.item if isinstance(m, Request) else m if isinstance(m, Metric) else parse_metric(m)


@dataclass(frozen=True)
class Execution:
    """A query that ran: its plans, and how long it took."""

    plan: str
    seconds: float


class Analysis:
    def __init__(self, project: Project, query: Query):
        self.project, self.query = project, query
        self.executed: list[Execution] = []

    def frame(self) -> DataFrame:
        """The lazy result."""
        return compiled(self.project.model, self.project.catalog, self.query)

    def df(self, format: bool = False) -> DataFrame:
        """The result; with format, its values as the text that is shown to people."""
        frame = self.frame()
        if not format:
            return frame
        ship(frame.sparkSession)
        names = frame.columns
        shown_as = [self.formatters()[c] for c in names]

        def texts(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([f.text(v) for v in column.to_pylist()], pa.string()) for f, column in zip(shown_as, b.columns, strict=True)], names)

        return frame.mapInArrow(texts, ", ".join(f"`{c}` string" for c in names))

    def formatters(self) -> dict[str, Formatter]:
        """How each column is shown."""
        model, found = self.project.model, {}
        for d in self.query.dimensions:
            base = model.unions.get(d.id) or model.dimensions.get(d.id)
            kind = dimension_type(model, d)
            same = base is not None and (not d.transforms or kind.name == base.type.name and kind.name != "datetime")
            found[d.name] = Formatter(kind, base.format if same else None, model.locale, model.currency)
        for m in self.query.metrics:
            transform = m.transforms[0].id if m.transforms else None
            style = {"percent": "percent", "count": None}.get(transform, model.metrics[m.id].format)
            found[m.name] = Formatter(metric_type(model, m), style, model.locale, model.currency)
        return found

    def toPandas(self, format: bool = False):  # noqa: N802  as Spark names it
        """The result on the driver; what ran is noted in `executed`."""
        frame, began = self.frame(), time.perf_counter()
        got = frame.toPandas()
        self.executed.append(Execution(frame._jdf.queryExecution().toString(), round(time.perf_counter() - began, 4)))
        return shown(got, self.formatters()) if format else got

    def graph(self) -> str:
        """The operators of the optimized plan and what feeds them, in the DOT language."""
        lines: list[str] = []

        def walk(node) -> str:
            name = f"n{len(lines)}"
            lines.append(f'  {name} [label="{node.nodeName()}"];')
            children = node.children()
            for i in range(children.size()):
                lines.append(f"  {walk(children.apply(i))} -> {name};")
            return name

        walk(self.frame()._jdf.queryExecution().optimizedPlan())
        return "\n".join(["digraph analysis {", *lines, "}"])

    def explain(self, mode: str = "formatted") -> None:
        self.frame().explain(mode)

    def text(self) -> str:
        return self.query.render()


class Select(Analysis):
    def __init__(self, project: Project, metrics):
        super().__init__(project, Query(tuple(_metric(m) for m in metrics)))

    def _more(self, **changes) -> Select:
        made = copy.copy(self)
        made.executed = []
        made.query = replace(self.query, **{k: (*getattr(self.query, k), *v) for k, v in changes.items()})
        return made

    def by(self, *dimensions) -> Select:
        return self._more(dimensions=tuple(_dimension(d) for d in dimensions))

    def where(self, *filters) -> Select:
        return self._more(filters=tuple(_dimension(f) for f in filters))

    def limit(self, *metrics) -> Select:
        return self._more(limits=tuple(_metric(m) for m in metrics))


#: Stands for the names of metrics among the rows or columns of a pivot.
METRICS = "$"


class Pivot(Select):
    def __init__(self, project: Project, metrics):
        super().__init__(project, metrics)
        self._rows: tuple[str, ...] = ()
        self._columns: tuple[str, ...] = ()

    def _axis(self, axis: str, dimensions) -> Pivot:
        made, names = self, []
        for d in dimensions:
            if d == METRICS if isinstance(d, str) else False:
                names.append(METRICS)
            else:
                item = _dimension(d)
                made = made._more(dimensions=(item,)) if item.key not in {x.key for x in made.query.dimensions} else made
                names.append(item.name)
        made = copy.copy(made)
        setattr(made, axis, (*getattr(self, axis), *names))
        return made

    def rows(self, *dimensions) -> Pivot:
        return self._axis("_rows", dimensions)

    def columns(self, *dimensions) -> Pivot:
        return self._axis("_columns", dimensions)

    def frame(self, values: list | None = None) -> DataFrame:
        """One row for each tuple of the row dimensions and one column for each of the column dimensions' and metrics'
        names. Spark looks up the column values first, unless they are given."""
        long = super().frame()
        if not self._rows and not self._columns:
            return long
        rows, columns = [*self._rows], [*self._columns]
        if METRICS not in rows and METRICS not in columns:
            columns.append(METRICS)
        names = [m.name for m in self.query.metrics]
        dims = [d.name for d in self.query.dimensions]
        kinds = {metric_type(self.project.model, m).spark for m in self.query.metrics}
        kind = kinds.pop() if len(kinds) == 1 else "double" if kinds <= {"double", "bigint"} else "string"
        quoted = [F.col(f"`{c}`") for c in dims]
        long = long.select(*quoted, *(F.col(f"`{n}`").cast(kind).alias(n) for n in names))
        long = long.unpivot(quoted, [F.col(f"`{n}`") for n in names], METRICS, "value#")
        keys = [F.col(f"`{c}`") for c in rows]
        if not columns:
            return long.select(*keys, F.col("`value#`").alias("value")).orderBy(*keys)
        axis = F.concat_ws(" / ", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in columns))
        wide = long.withColumn("axis#", axis).groupBy(*keys).pivot("axis#", values).agg(F.first("value#"))
        return wide.orderBy(*(k.asc_nulls_first() for k in keys)) if keys else wide


class Project:
    """A model and where its tables come from."""

    def __init__(self, spark: SparkSession, model: dict, catalog: Catalog | None = None, files: ModelFiles | None = None):
        self.spark, self.data, self.files = spark, copy.deepcopy(model), files
        self.catalog = catalog or Catalog(spark)
        self.model = Model(self.data)
        self.m = Names(Metric, lambda: self.model.metrics)
        self.d = Names(Dimension, lambda: [*self.model.dimensions, *self.model.unions, *GENERIC_TIME])

    @classmethod
    def from_path(cls, spark: SparkSession, path: str | Path, profile: str | None = None) -> Project:
        """A project folder: project.yml, profiles.yml, and folders of tables and metrics."""
        settings = load_project(path)
        files = ModelFiles.read(settings)
        found = load_profile(settings, profile)
        catalog = Catalog.from_profile(spark, found["type"], found.get("parameters") or {})
        return cls(spark, files.model(), catalog, files)

    @classmethod
    def example(cls, spark: SparkSession) -> Project:
        """A small project with its data, to try things on."""
        return cls(spark, example.MODEL, Catalog(spark, frames=example.frames(spark)))

    @classmethod
    def new(cls, spark: SparkSession, path: str | Path, name: str = "project", backend: str = "spark", parameters: dict | None = None, locale: str = "en_US", currency: str = "USD") -> Project:
        """A new, empty project folder."""
        scaffold(path, name, backend, parameters or {}, locale, currency)
        return cls.from_path(spark, path)

    def select(self, *metrics) -> Select:
        return Select(self, metrics)

    def pivot(self, *metrics) -> Pivot:
        return Pivot(self, metrics)

    def ql(self, text: str) -> Analysis:
        return Analysis(self, parse_query(text))

    def frame(self, query: Query) -> DataFrame:
        return compiled(self.model, self.catalog, query)

    def describe(self) -> DataFrame:
        """Which dimension can be asked of which metric: a row for each dimension, a mark for each metric."""
        dims = [*self.model.dimensions, *self.model.unions, *GENERIC_TIME]
        known = {m: {*self.model.dimensions_of(m), *self.model.time_dimensions_of(m)} for m in self.model.metrics}
        rows = [(d, *("+" if d in known[m] else None for m in known)) for d in dims]
        return self.spark.createDataFrame(rows, ", ".join(["dimension string", *(f"`{m}` string" for m in known)]))

    def outline(self) -> dict:
        """The model as plain data: its metrics with their types, formats, lineage and the dimensions they go by."""
        model = self.model

        def told(item, kind) -> dict:
            made = {"id": item.id, "name": item.name, "description": item.description, "expr": getattr(item, "text", None)}
            return made | {"type": {"name": kind.name, "grain": kind.grain}, "format": {"pattern": item.format, "d3": Formatter(kind, item.format, model.locale, model.currency).d3}}

        def metric(m) -> dict:
            known = [model.unions.get(d) or model.dimensions[d] for d in model.dimensions_of(m.id)]
            return told(m, m.type) | {"lineage": model.lineage(m.id), "dimensions": [told(d, d.type) for d in known], "time": model.time_dimensions_of(m.id)}

        return {"name": model.name, "description": model.description, "metrics": [metric(m) for m in model.metrics.values()]}

    def suggest_dimensions(self, *metrics: str) -> list[str]:
        """Dimensions by which all of these metrics can be asked."""
        sets = [{*self.model.dimensions_of(m), *self.model.time_dimensions_of(m)} for m in metrics]
        return sorted(set.intersection(*sets)) if sets else []

    def suggest_metrics(self, *dimensions: str) -> list[str]:
        return self.model.metrics_by(list(dimensions))

    def update(self, changes: dict) -> None:
        """Merge changes into the model; if the outcome isn't valid, nothing changes."""
        data = merged_model(self.data, changes)
        model = Model(data)
        self.data, self.model = data, model
        if self.files is not None:
            self.files.changed(data)

    def write(self) -> list[Path]:
        """Write the model's changes to its files."""
        if self.files is None:
            raise ProjectError("the project has no folder")
        return self.files.write()


def merged_model(data: dict, changes: dict) -> dict:
    """Nested dicts merged; everything else replaced."""
    out = dict(data)
    for k, v in changes.items():
        out[k] = merged_model(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out
