"""Table sources: how the `source` of a model's table becomes a DataFrame.

A source is the name of a table or view, {schema, table}, {format, path, options} for anything Spark reads, or a dict
with a `type` for which a resolver is registered. A Catalog may also name a root folder whose Parquet files are tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..errors import ModelError
from ..shipping import ship

Resolver = Callable[[SparkSession, dict], DataFrame]

_RESOLVERS: dict[str, Resolver] = {}


def register_source(kind: str, resolver: Resolver) -> None:
    """Make {type: kind, ...} a source."""
    _RESOLVERS[kind] = resolver


def source_kinds() -> list[str]:
    return sorted(_RESOLVERS)


def _reader(spark: SparkSession, source: dict) -> DataFrame:
    return spark.read.format(source.get("format", "parquet")).options(**(source.get("options") or {})).load(source.get("path"))


def _jdbc(spark: SparkSession, source: dict) -> DataFrame:
    """Any database with a JDBC driver on the class path; partitioned reads by Spark's own options."""
    return spark.read.format("jdbc").option("url", source["url"]).option("dbtable", source["table"]).options(**(source.get("options") or {})).load()


def _sqlite(spark: SparkSession, source: dict) -> DataFrame:
    """A file of SQLite, read by Python workers."""
    from .sqlite import SqliteSource

    ship(spark)
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_file").option("database", source["database"]).option("table", source["table"]).options(**(source.get("options") or {})).load()


def _query(spark: SparkSession, source: dict) -> DataFrame:
    return spark.sql(source["sql"])


for _kind, _resolver in {"file": _reader, "jdbc": _jdbc, "sqlite": _sqlite, "query": _query}.items():
    register_source(_kind, _resolver)


class Catalog:
    """Resolves sources for one session; parameters come from a profile."""

    def __init__(self, spark: SparkSession, root: str | None = None, default_schema: str | None = None, frames: dict[str, DataFrame] | None = None):
        self.spark, self.root, self.default_schema, self.frames = spark, root, default_schema, frames or {}
        self._schemas: dict[str, tuple[list, StructType]] = {}

    @classmethod
    def from_profile(cls, spark: SparkSession, kind: str, parameters: dict) -> Catalog:
        if kind not in ("spark", "parquet"):
            raise ModelError(f"there is no backend {kind}; sources of other kinds are named on each table")
        return cls(spark, parameters.get("path"), parameters.get("default_schema"))

    def frame(self, source: object) -> DataFrame:
        if isinstance(source, DataFrame):
            return source
        if isinstance(source, str):
            if source in self.frames:
                return self.frames[source]
            if self.root:
                return self._parquet(f"{self.root}/{source}.parquet")
            return self.spark.table(f"{self.default_schema}.{source}" if self.default_schema and "." not in source else source)
        if not isinstance(source, dict):
            raise ModelError(f"{source!r} isn't a source")
        if "type" in source:
            if source["type"] not in _RESOLVERS:
                raise ModelError(f"no source of type {source['type']!r} is registered")
            return _RESOLVERS[source["type"]](self.spark, source)
        if "path" in source or "format" in source:
            return _reader(self.spark, source)
        if "table" not in source:
            raise ModelError("a source needs a table, a path or a type")
        return self.spark.table(f"{source['schema']}.{source['table']}" if source.get("schema") else source["table"])

    def _parquet(self, path: str) -> DataFrame:
        """Footers are read for the schema once, as long as the same files are there; the files are listed anew each time."""
        files = _listed(self.spark, path)
        if self._schemas.get(path, (None,))[0] != files:
            self._schemas[path] = files, self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[path][1]).parquet(path)


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, size and time of a path, or of what lies in a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [(x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
