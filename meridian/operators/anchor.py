"""One anchor table with what its expressions need joined to it.

Columns are named by their path of relations, so self joins and equal names never clash. A relation is joined the first
time a column of it is asked for, as a left outer join from foreign to related key, and only once. A measure for each
row of a table on the path (a level) is a second aggregation by that table's primary key, joined in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidReferenceError
from ..functions.expressions import all_of, column_of
from ..model import Model, Place
from ..plans.syntax import Node
from ..sources.tables import Catalog

Path = tuple[str, ...]


def _named(path: Path, column: str) -> str:
    return "/".join((*path, column.lower()))


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Anchor:
    def __init__(self, model: Model, catalog: Catalog, table: str):
        self.model, self.catalog, self.table = model, catalog, table
        self.columns: dict[Path, set[str]] = {}
        self.levels: dict[tuple[Path, str], str] = {}
        self.frame = self._scan((), table)

    def _scan(self, path: Path, table: str) -> DataFrame:
        df = self.catalog.frame(self.model.tables[table].source)
        self.columns[path] = {c.lower() for c in df.columns}
        return df.select(*(_quoted(c).alias(_named(path, c)) for c in df.columns))

    def _joined(self, path: Path) -> None:
        if path in self.columns:
            return
        self._joined(path[:-1])
        relation = self.model.tables[self.model.target(self.table, path[:-1])].related[path[-1]]
        left = self._raw(path[:-1], relation.foreign_key)
        right = self._scan(path, relation.table)
        self.frame = self.frame.join(right, left == self._raw(path, relation.related_key), "left")

    def _raw(self, path: Path, column: str) -> Column:
        if column.lower() not in self.columns[path]:
            raise InvalidReferenceError(f"{self.model.target(self.table, path)} has no column {column}")
        return _quoted(_named(path, column))

    def _level(self, path: Path, measure: str) -> Column:
        name = "/".join((*path, f"${measure}"))
        if (path, measure) not in self.levels:
            host = self.model.target(self.table, path)
            key = self.model.tables[host].primary_key
            self._joined(path)
            by_host = f"{name}#key"
            made = level(self.model, self.catalog, measure, host, by_host, name)
            self.frame = self.frame.join(made, self._raw(path, key) == _quoted(by_host), "left").drop(by_host)
            self.levels[path, measure] = name
        return _quoted(name)

    def column(self, tree: Node) -> Column:
        """The column of a resolved tree; joins what it needs to self.frame."""
        for n in tree.walk():
            if n.kind == "column":
                self._joined(n.value[:-1])
            elif n.kind == "level":
                self._level(*n.value)
        return column_of(tree, lambda n: self._raw(n.value[:-1], n.value[-1]) if n.kind == "column" else self._level(*n.value))

    def key(self, path: Path, column: str) -> Column:
        """A key column at a path; that of a relation's own key is its foreign key, for which nothing is joined."""
        if path:
            relation = self.model.tables[self.model.target(self.table, path[:-1])].related[path[-1]]
            if relation.related_key.lower() == column.lower():
                self._joined(path[:-1])
                return self._raw(path[:-1], relation.foreign_key)
        self._joined(path)
        return self._raw(path, column)

    def dimension(self, place: Place) -> Column:
        return self.column(self.model.dimension_tree(place)).cast(place.dimension.type.spark)

    def where(self, conditions: list[Column]) -> None:
        if conditions:
            self.frame = self.frame.where(all_of(conditions))

    def filter_table(self) -> None:
        """Apply the filters that always hold for this table."""
        self.where([self.column(self.model.row_tree(f, self.table)) for f in self.model.tables[self.table].filters])


def level(model: Model, catalog: Catalog, measure: str, host: str, key: str, name: str) -> DataFrame:
    """(key, name): a measure for each primary key of a host table, with the measure's and its table's filters."""
    m = model.measures[measure]
    anchor = Anchor(model, catalog, m.table)
    path = model.measure_path(measure, host)
    by = anchor.key(path, model.tables[host].primary_key).alias(key)
    anchor.filter_table()
    if m.filter is not None:
        anchor.where([anchor.column(model.row_tree(m.filter, m.table))])
    value = anchor.column(model.measure_tree(m)).cast(m.type.spark)
    return anchor.frame.groupBy(by).agg(value.alias(name))
