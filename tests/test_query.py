import pytest

from lyrebird.plans.query import can_match, fold, holds, parse, set_sql, terms

GOLDEN = {
    "a": "a", "a b": "AND(a, b)", "a && b": "AND(a, b)", "a || b c": "OR(a, AND(b, c))", "!a b": "AND(NOT(a), b)",
    "!!a": "NOT(NOT(a))", "!(a || b) c": "AND(NOT(OR(a, b)), c)", "(a || b) c": "AND(OR(a, b), c)",
    "(a b) c": "AND(AND(a, b), c)", "a &&": "a", "a && && b": "AND(a, b)", "|| a": None, "a || || b": "OR(a, b)",
    "a ||": "a", "!": None, "() a": None, "a () b": "a", "": None, "  \t": None, "a ! b": "AND(a, NOT(b))",
    "a(b)c": "AND(a, b, c)", "(a": "a", "a) b": "a", "a b)c": "AND(a, b)", "a|b": "a", "a&b": "a", "a -b": "a",
    "-a b": "AND(-a, b)", "a && -b": "AND(a, -b)", "a _b": "a", "a-b": "a-b", "café x": "caf", "ünder": None, "x é y": "x",
    "Москва ёж": "AND(Москва, ёж)", "a, b": "a", '"a b"': None, "a AND b": "AND(a, AND, b)", "a !": "a",
    "(a || ) b": "AND(a, b)", "a!b": "AND(a, NOT(b))",
}


@pytest.mark.parametrize("query", GOLDEN)
def test_parse(query):
    node = parse(query)
    assert (None if node is None else str(node)) == GOLDEN[query]


def test_null_query():
    assert parse(None) is None and terms(None) == []


def test_terms_fold_and_drop_what_no_index_holds():
    assert terms(parse("Ёлка && foo-bar || x || ÉА aa AA")) == ["ёлка"]
    assert not can_match(parse("x")) and not can_match(parse("foo_bar"))
    assert fold("Éлка ЁЖ") == "Éлка ёж"


def test_holds():
    node = parse("!(aa || bb) cc")
    assert holds(node, {"cc": True}) and not holds(node, {"aa": True, "cc": True}) and not holds(node, {})


def test_set_sql_escapes():
    assert "''" not in set_sql(parse("don")) and "where false" in set_sql(None)
