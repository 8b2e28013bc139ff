"""Expressions and requests: trees, names, text forms."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from meridian.errors import ExpressionSyntaxError, QuerySyntaxError
from meridian.plans.request import Dimension, Metric, Query, Transform, parse_dimension, parse_metric, parse_query
from meridian.plans.syntax import Node, parse


def shape(n: Node) -> str:
    if n.kind == "call":
        return f"{n.value}({', '.join(map(shape, n.args))})"
    mark = {"measure": "$", "dimension": ":"}.get(n.kind, "")
    return mark + (".".join(n.value) if n.kind == "column" else repr(n.value) if n.kind == "literal" else str(n.value))


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("1", "1"), ("1.5", "1.5"), ("'a b'", "'a b'"), ("TRUE", "True"), ("false", "False"), ("x", "x"), ("a.b.c", "a.b.c"), ("$m", "$m"), (":d", ":d"), ("-1", "neg(1)"),
        ("-x ** 2", "neg(pow(x, 2))"), ("2 ** 3 ** 2", "pow(pow(2, 3), 2)"), ("1 + 2 * 3 - 4", "sub(add(1, mul(2, 3)), 4)"), ("(1 + 2) * 3", "mul(add(1, 2), 3)"), ("7 // 2 % 3", "mod(floordiv(7, 2), 3)"),
        ("x = 1", "eq(x, 1)"), ("x == 1", "eq(x, 1)"), ("x <> 1", "ne(x, 1)"), ("x != 1", "ne(x, 1)"), ("a < b + 1", "lt(a, add(b, 1))"), ("x is null", "isnull(x)"), ("x IS NOT NULL", "not(isnull(x))"),
        ("x in (1, 2)", "in(x, 1, 2)"), ("x not in ('a')", "not(in(x, 'a'))"), ("not x or y and z", "or(not(x), and(y, z))"), ("not x in (1)", "not(in(x, 1))"), ("1and(1)", "and(1, 1)"), ("1or(0)", "or(1, 0)"),
        ("case when x then 1 when y then 2 else 3 end", "if(x, 1, y, 2, 3)"), ("case when x then 1 end", "if(x, 1)"), ("IF(x, 1, 2)", "if(x, 1, 2)"), ("COUNT()", "count()"), ("count(*)", "count()"),
        ("Sum(a * b) / countd(c.d)", "div(sum(mul(a, b)), countd(c.d))"), ('"odd name" + 1', "add(odd name, 1)"), ("'it''s'", '"it\'s"'), ("1e3", "1000.0"),
    ],
)
def test_expression_trees(text, tree):
    assert shape(parse(text)) == tree


@pytest.mark.parametrize("text", ["", "1 +", "(1", "a in ()", "case end", "case when 1 then end", "a b", "#", "f(1,", "$a.b + ", "a not 1", "then"])
def test_bad_expressions(text):
    with pytest.raises(ExpressionSyntaxError):
        parse(text)


numbers = st.integers(0, 99).map(str)
trees = st.recursive(
    numbers, lambda inner: st.tuples(inner, st.sampled_from(["+", "-", "*", "/", "//", "%", "**", "<", "and", "or"]), inner).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), max_leaves=8
)


@given(trees)
def test_parentheses_decide(text):
    def written(n: Node) -> str:
        marks = {"add": "+", "sub": "-", "mul": "*", "div": "/", "floordiv": "//", "mod": "%", "pow": "**", "lt": "<", "and": "and", "or": "or"}
        return str(n.value) if n.kind == "literal" else f"({written(n.args[0])} {marks[n.value]} {written(n.args[1])})"

    assert written(parse(text)) == text


def test_request_names():
    assert Dimension("x").name == "x"
    assert Dimension("x", (Transform("y", ("a", 1)),)).name == "x__y_a_1"
    assert Dimension("x", (Transform("y"), Transform("z", (2,)))).name == "x__y_z_2"
    within = Dimension("b", (Transform("s", ("ab",)),))
    assert Metric("x", (Transform("y", (1,), (Dimension("a"),), (within,)),)).name == "x__y_1_of_a_within_b__s_ab"
    assert Metric("x", (), "z").name == "z"


def test_request_text():
    year = Dimension("x", (Transform("year"),))
    assert Transform("t", (1, "a", True, 1.5)).render() == "t(1, 'a', TRUE, 1.5)"
    assert Metric("m", (Transform("t", (1,), (year, Dimension("y")), (Dimension("z"),)),), "as it is").render() == 'm.t(1) of (x.year(), y) within (z) as "as it is"'


QUERIES = [
    "select a", "select a, b as c", "select a where x", "select a where x > 1, y is null, z in ('a', 2) by x", "select a group by x.year as y, z.step(10)",
    "select a.percent, a.total of (x) within (y.year) by x, y.year limit a.top(5), b.bottom(2) within (y.year)", "SELECT a WHERE x.isin(1, 2).not BY \"Year\"", "select a where x = -1.5, y is not null, z = 'it\\'s'",
]


@pytest.mark.parametrize("text", QUERIES)
def test_rendered_requests_read_the_same(text):
    assert parse_query(parse_query(text).render()) == parse_query(text)


def test_request_parts():
    q = parse_query("select a.percent within (x) as p where d.not, e != 2, f is not null, g <> TRUE by x.YEAR limit b.top(3)")
    assert q == Query(
        (Metric("a", (Transform("percent", (), (), (Dimension("x"),)),), "p"),), (Dimension("x", (Transform("year"),)),),
        (Dimension("d", (Transform("invert"),)), Dimension("e", (Transform("ne", (2,)),)), Dimension("f", (Transform("isnotnull"),)), Dimension("g", (Transform("ne", (True,)),))),
        (Metric("b", (Transform("top", (3,)),)),),
    )
    assert parse_metric("a.sum of (x)").transforms[0].of == (Dimension("x"),) and parse_dimension('"Odd one" as "z z"').name == "z z"


@pytest.mark.parametrize("text", ["", "select", "a by b", "select a limit b.top(1)", "select a by", "select a where x = ", "select a by b limit", "select a b", "select a by x y", "select a.t(", "select a where x not (1)", "select a where x not in 1"])
def test_bad_requests(text):
    with pytest.raises(QuerySyntaxError):
        parse_query(text)
