"""Model loading, join paths, checks and lineage."""

import copy

import pytest

from meridian import errors as e
from meridian.model import Model
from meridian.types import Type, coarser, type_of

BASE = {
    "name": "t",
    "tables": {
        "t1": {
            "source": "t1", "primary_key": "pk", "related": {"t2": {"table": "t2", "foreign_key": "fk"}},
            "dimensions": {"d1": {"type": "str", "expr": "col"}, "d2": {"type": "float", "expr": "$me1"}, "when": {"type": "date", "expr": "t2.at"}},
            "measures": {"me1": {"expr": "sum(value)", "time": "when"}, "me3": {"expr": "$me1 / count()", "filter": "value > 0"}}, "filters": ["value is not null"],
        },
        "t2": {"source": "t2", "primary_key": "id", "dimensions": {"d3": {"type": "int", "expr": "x"}}, "measures": {"n2": {"expr": "count()", "type": "int"}}},
    },
    "metrics": {"m1": {"expr": "sum(other)", "table": "t1", "filter": ":d1 = 'a'"}, "m2": {"expr": "$me1 / $n2"}, "m3": {"expr": "$m2 * 2", "missing": 0}},
}


def changed(path: str, value):
    config = copy.deepcopy(BASE)
    *way, last = path.split("/")
    at = config
    for p in way:
        at = at.setdefault(p, {})
    if value is None:
        at.pop(last)
    else:
        at[last] = value
    return config


def test_base_is_valid():
    m = Model(BASE)
    assert set(m.metrics) == {"me1", "me3", "n2", "m1", "m2", "m3"} and set(m.measures) == {"me1", "me3", "n2", "m1"}
    assert m.measures_of("m3") == ["me1", "n2"]
    assert m.dimensions_of("me1") == ["d1", "d2", "d3", "when"] and m.dimensions_of("m2") == ["d3"]
    assert m.time_dimensions("me1") == ["Time", "Year", "Quarter", "Month", "Week", "Day", "Date"] and m.time_dimensions_of("m2") == []
    assert m.metrics_by(["d1"]) == ["me1", "me3", "m1"]
    assert m.total_function("me1") == "sum" and m.total_function("n2") == "sum" and m.total_function("me3") is None


@pytest.mark.parametrize(
    ("path", "value", "error"),
    [
        ("tables/T9", {"source": "x"}, e.InvalidIDError), ("tables/__x", {"source": "x"}, e.InvalidIDError), ("metrics/a b", {"expr": "$me1"}, e.InvalidIDError), ("tables/t1/dimensions/1x", {"type": "int", "expr": "x"}, e.InvalidIDError),
        ("tables/t1/related/zz", {"table": "no", "foreign_key": "x"}, e.MissingTableError), ("tables/t2/primary_key", None, e.MissingRelatedKeyError), ("tables/t2/dimensions/d1", {"type": "str", "expr": "y"}, e.DuplicateCalculationError),
        ("tables/t1/dimensions/d1/union", "no", e.MissingCalculationError), ("metrics/m2/time", "when", e.MissingMetricTableError), ("metrics/m2/filter", "x > 1", e.MissingMetricTableError), ("metrics/m1/table", "no", e.MissingMetricTableError),
        ("tables/t1/measures/me1/time", "d1", e.MissingCalculationError), ("tables/t1/measures/me1/time", "no", e.MissingCalculationError), ("metrics/m2/expr", "$me1 +", e.ExpressionSyntaxError),
        ("metrics/m2/expr", ":d1", e.InvalidReferenceError), ("metrics/m2/expr", "col", e.InvalidReferenceError), ("metrics/m2/expr", "sum($me1)", e.InvalidReferenceError), ("metrics/m2/expr", "$no", e.MissingMeasureError),
        ("tables/t1/dimensions/d1/expr", "nofun(col)", e.UnknownFunctionError), ("tables/t1/dimensions/d1/expr", "abs(col, 1)", e.UnknownFunctionError), ("tables/t1/dimensions/d1/expr", "@ + 1", e.InvalidReferenceError),
        ("tables/t1/dimensions/d1/expr", ":no", e.MissingDimensionError), ("tables/t1/dimensions/d1/expr", "$no", e.MissingMeasureError), ("tables/t1/dimensions/d1/expr", "no.col", e.InvalidReferenceError), ("tables/t1/measures/me1/expr", "$n2", e.MissingMeasureError),
        ("tables/t1/measures/me1/expr", "sum(x) + y", e.MixedAggregationError), ("tables/t1/measures/me1/expr", "sum(sum(x))", e.NestedAggregateError), ("tables/t1/measures/me1/expr", "value", e.NonAggregateMeasureError),
        ("tables/t1/dimensions/d1/expr", "sum(value)", e.AggregateDimensionError), ("tables/t1/filters", ["sum(value) > 1"], e.AggregateDimensionError), ("tables/t1/measures/me3/filter", "count() > 1", e.AggregateDimensionError),
        ("tables/t1/measures/me1/expr", "$me3 + 0", e.FilteredMeasureReferenceError), ("tables/t1/dimensions/d1/expr", ":d1", e.CircularReferenceError), ("tables/t1/measures/me1/expr", "$me1 + 1", e.CircularReferenceError),
        ("metrics/m2/expr", "$m3", e.CircularReferenceError), ("tables/t1/primary_key", None, e.MissingPrimaryKeyError), ("tables/t1/dimensions/d1/type", "decimal", e.ModelError), ("metrics/me1", {"expr": "$n2"}, e.DuplicateCalculationError),
        ("tables/t2/dimensions/d3/expr", "$me1", None), ("tables/t1/dimensions/d1/expr", "$m2", e.MissingMeasureError),
    ],
)
def test_checks(path, value, error):
    if error is None:
        Model(changed(path, value))
    else:
        with pytest.raises(error):
            Model(changed(path, value))


def graph(edges: dict[str, list[tuple[str, str]]]) -> Model:
    return Model({"tables": {t: {"source": t, "primary_key": "id", "related": {a: {"table": to, "foreign_key": a} for a, to in rel}} for t, rel in edges.items()}})


def test_join_paths():
    m = graph({"a": [("b", "b"), ("me", "a"), ("c", "c")], "b": [("d", "d")], "c": [("d", "d"), ("e", "e")], "d": [("f", "f")], "e": [("a", "a")], "f": []})
    assert m.join_paths("a") == {"b": ("b",), "c": ("c",), "e": ("c", "e"), "a": ("me",)}
    assert m.join_paths("b") == {"d": ("d",), "f": ("d", "f")}
    assert m.join_paths("e")["c"] == ("a", "c") and "d" not in m.join_paths("e")
    direct = graph({"a": [("b", "b"), ("d", "d")], "b": [("d", "d")], "d": []})
    assert direct.join_paths("a")["d"] == ("d",)
    twice = graph({"a": [("x", "b"), ("y", "b")], "b": []})
    assert twice.join_paths("a") == {}


def test_lineage():
    rows = {(r["id"], r["parent"]) for r in Model(BASE).lineage("m3")}
    assert rows == {
        ("metric:m3", None), ("metric:m2", "metric:m3"), ("measure:t1.me1", "metric:m2"), ("column:t1.value", "measure:t1.me1"), ("measure:t2.n2", "metric:m2"),
    }


def test_types():
    assert type_of("date") == Type("datetime", "day") and type_of("datetime") == Type("datetime", "second") and type_of("date:month").grain == "month" and type_of("str").spark == "string"
    assert coarser("week") == ["year", "week"] and coarser("day") == ["year", "quarter", "month", "week", "day"] and coarser("month") == ["year", "quarter", "month"]
    for bad in ("decimal", "int:day", "date:century"):
        with pytest.raises(ValueError):
            type_of(bad)


def test_currencies():
    m = Model(changed("metrics/m3/format", {"kind": "currency", "currency": "EUR"}))
    assert m.currencies(["m3", "m2", "d1"]) == {"EUR"}
