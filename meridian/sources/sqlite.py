"""SQLite files as a Spark data source, without a JDBC driver: `spark.read.format("sqlite_file")` with the options
`database` and `table`, and `partitions` for a read in ranges of row numbers. Executors must see the file."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, BooleanType, DataType, DoubleType, LongType, StringType, StructType, TimestampNTZType

#: Parts of declared types, as SQLite's own affinities read them in this order, and what they become.
KINDS: tuple[tuple[str, DataType], ...] = (
    ("BOOL", BooleanType()), ("DATE", TimestampNTZType()), ("TIMESTAMP", TimestampNTZType()), ("INT", LongType()), ("CHAR", StringType()), ("CLOB", StringType()),
    ("TEXT", StringType()), ("BLOB", BinaryType()), ("REAL", DoubleType()), ("FLOA", DoubleType()), ("DOUB", DoubleType()), ("NUMERIC", DoubleType()), ("DECIMAL", DoubleType()),
)


def _kind(declared: str) -> DataType:
    return next((kind for part, kind in KINDS if part in declared.upper()), StringType())


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _opened(database: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{re.sub('[?#%]', lambda m: f'%{ord(m[0]):02x}', database)}?mode=ro", uri=True)


class Rows(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        super().__init__((low, high))


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.database, self.table, self.wanted = options["database"], options["table"], max(1, int(options.get("partitions", "1")))
        self.fields = [(f.name, f.dataType) for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        with _opened(self.database) as db:
            if db.execute("select type from sqlite_master where name = ?", (self.table,)).fetchone() != ("table",):
                return [Rows(None, None)]
            try:
                low, high = db.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a table without row numbers
                return [Rows(None, None)]
        if low is None:
            return [Rows(0, -1)]
        step = -(-(high - low + 1) // self.wanted)
        return [Rows(at, min(at + step - 1, high)) for at in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        from datetime import datetime

        low, high = partition.value
        text = f"select {', '.join(_quoted(n) for n, _ in self.fields)} from {_quoted(self.table)}" + (f" where rowid between {low} and {high}" if low is not None else "")
        make = {
            TimestampNTZType: lambda v: datetime.fromisoformat(v) if isinstance(v, str) else datetime.fromtimestamp(v), BooleanType: bool, LongType: int, DoubleType: float, StringType: str, BinaryType: bytes,
        }
        kinds = [make[type(kind)] for _, kind in self.fields]
        with _opened(self.database) as db:
            for row in db.execute(text):
                yield tuple(None if v is None else f(v) for f, v in zip(kinds, row, strict=True))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def schema(self) -> StructType:
        found = StructType()
        with _opened(self.options["database"]) as db:
            for _, column, declared, *_ in db.execute(f"pragma table_info({_quoted(self.options['table'])})"):
                found.add(column, _kind(declared or ""))
        if not found.fields:
            raise ValueError(f"{self.options['database']} has no table {self.options['table']}")
        return found

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)
