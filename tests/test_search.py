import random

import pytest
from pyspark.sql import functions as F

from lyrebird.operators.index import build, dense_ids, document_count, per_second
from lyrebird.operators.search import batch, matches, matches_by_sets, page_count, page_of, paged, response_json, search, total
from lyrebird.plans.query import And, Not, Or, Term, holds
from lyrebird.sources.index_store import load_config, open_index, read_binary, read_documents, store_uri, write_binary, write_index

PAGES = [
    (10, "http://h/a", "<title>A</title> red green"),
    (11, None, "<title>B - x</title> red"),
    (12, "http://h/c", ""),
    (13, "http://h/d", None),
    (14, "http://h/e", "<h1>E</h1> green blue blue"),
    (15, "http://h/f", "<p>кот и Ёж</p>"),
]


@pytest.fixture(scope="module")
def idx(spark):
    return build(spark.createDataFrame(PAGES, "page_id bigint, url string, html_content string"))


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_documents(idx):
    assert [tuple(r) for r in idx.docs.orderBy("doc_id").select("doc_id", "title", "url").collect()] == [
        (0, "A", "http://h/a"), (1, "B", ""), (2, "E", "http://h/e"), (3, "Untitled", "http://h/f"),
    ]


def test_limit_counts_empty_pages(spark):
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(["x", "", "y", "z"])], "page_id bigint, url string, html_content string")
    assert build(df, limit=2).docs.count() == 1 and build(df).docs.count() == 3
    assert document_count(df) == 4 and document_count(df, 2) == 2 and per_second(5, 0) == 0.0


def test_empty_table(spark):
    empty = build(spark.createDataFrame([], "page_id bigint, url string, html_content string"))
    row = empty.stats.first()
    assert (row.total_documents, row.total_tokens, row.unique_terms, row.avg_term_length) == (0, 0, 0, 0.0)
    assert matches(empty, "!a").count() == 0


def test_statistics(idx):
    row = idx.stats.first()
    assert (row.total_documents, row.unique_terms, row.total_postings) == (4, 5, 7)
    got = {r.term: (r.df, r.postings) for r in idx.inverted().collect()}
    assert got["red"] == (2, [0, 1]) and got["кот"] == (1, [3]) and got["ёж"] == (1, [3])


def test_queries(idx):
    expect = {"red": [0, 1], "RED && green": [0], "red green": [0], "red || blue": [0, 1, 2], "!red": [2, 3], "!!red": [0, 1], "nosuch": [], "": [], "|| a": [], "foo-bar": [], "!foo-bar": [0, 1, 2, 3], "ЁЖ": [3]}
    for q, want in expect.items():
        assert ids(matches(idx, q)) == want, q
        assert ids(matches_by_sets(idx, q)) == want, q


def tree(rng, depth):
    kind = rng.randrange(4) if depth else 0
    if kind == 0:
        return Term(rng.choice(["red", "green", "blue", "ёж", "nosuch", "x"]))
    if kind == 1:
        return Not(tree(rng, depth - 1))
    return (And if kind == 2 else Or)(tuple(tree(rng, depth - 1) for _ in range(rng.randrange(2, 4))))


def test_fused_plan_against_sets_and_brute_force(idx):
    rng = random.Random(5)
    docs = {}
    for r in idx.postings.collect():
        docs.setdefault(r.doc_id, {})[r.term] = True
    for i in range(12):
        node = tree(rng, 3)
        want = [d for d in range(4) if holds(node, docs.get(d, {}))]
        assert ids(matches(idx, node)) == want, str(node)
        if i < 5:
            assert ids(matches_by_sets(idx, node)) == want, str(node)


def test_one_scan_whatever_the_tree(idx):
    plan = matches(idx, "(red || green) && !blue && (ёж || red)")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") <= 1


def test_pages(idx):
    found = matches(idx, "!nosuch")
    assert [r.doc_id for r in paged(found, 2, 1).collect()] == [1, 2]
    whole = [r.doc_id for p in (1, 2, 3) for r in page_of(found, p, 2).collect()]
    assert whole == [0, 1, 2, 3] and page_of(found, 0, 2).count() == 0
    assert page_count(0) == 1 and page_count(51) == 2
    assert total(found, "q").first().total_count == 4


def test_batch(idx):
    rows = batch(idx, ["red", " ", "!red", "|| x", "a-b"]).collect()
    assert sorted((r.query_no, r.doc_id) for r in rows) == [(0, 0), (0, 1), (1, 2), (1, 3)]
    assert batch(idx, []).count() == 0


def test_json_is_escaped(spark):
    import json

    index = build(spark.createDataFrame([(1, 'u"v', '<title>a "b"</title>red')], "page_id bigint, url string, html_content string"))
    got = json.loads(response_json(matches(index, "red"), 're"d').first().json)
    assert got == {"query": 're"d', "total": 1, "results": [{"title": 'a "b"', "url": 'u"v'}]}


def test_search(idx):
    r = search(idx, "red", limit=1)
    assert r.total_count == 2 and len(r.results) == 1 and search(idx, "").total_count == 0


def test_stored_index(idx, tmp_path, spark):
    write_index(idx, f"file://{tmp_path}/i")
    again = open_index(spark, f"file://{tmp_path}/i")
    assert ids(matches(again, "red !green")) == [1]
    with pytest.raises(ValueError):
        open_index(spark, f"file://{tmp_path}/none")


def test_binary_index(idx, tmp_path, spark):
    path = str(tmp_path / "index.bin")
    write_binary(idx, path)
    docs, postings = read_binary(spark, path)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, idx.docs.select("doc_id", "title", "url").collect()))
    assert sorted(map(tuple, postings.collect())) == sorted(map(tuple, idx.postings.select("term", "doc_id").collect()))
    (tmp_path / "bad").write_bytes(b"no")
    with pytest.raises(ValueError):
        read_binary(spark, str(tmp_path / "bad"))


def test_dense_ids(spark):
    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "k int, v int").repartition(5)
    rows = dense_ids(df, "k").orderBy("k").collect()
    assert [r.doc_id for r in rows] == list(range(101))


def test_config_and_documents(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"db": {"database": "d"}, "logic": {"max_depth": 3}}')
    config = load_config(str(tmp_path / "c.json"))
    assert config["db"]["port"] == 27017 and config["logic"]["max_depth"] == 3 and config["logic"]["recheck_interval_days"] == 7
    assert store_uri(config["db"]) == "mongodb://localhost:27017"
    assert store_uri(config["db"] | {"username": "u", "password": "p"}) == "mongodb://u:p@localhost:27017"
    (tmp_path / "d.json").write_text('[{"url": "a", "html_content": "x"}, {"url": "b"}]')
    assert sorted(map(tuple, read_documents(spark, f"file://{tmp_path}/d.json").collect())) == [("a", "x"), ("b", "")]


def test_blocks_hold_the_same_lists(idx):
    whole = {r.term: r.postings for r in idx.inverted().collect()}
    parts = {}
    for r in idx.blocks(2).orderBy("term", "block").collect():
        assert r.df == len(r.postings) <= 2
        parts.setdefault(r.term, []).extend(r.postings)
    assert parts == whole


def test_terms_reach_the_scan(spark):
    """The postings are a table sorted by term: a search's filter is in the scan, and no text is read for it."""
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<title>T{i}</title>red w{i}") for i in range(20)], "page_id bigint, url string, html_content string")
    index = build(pages)
    plan = index.postings.where(F.col("term").isin(["red", "w3"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [red,w3])]" in plan and "Generate" not in plan
    plan = matches(index, "red && !w3")._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [" in plan and "toks" not in plan
    assert matches(index, "red && !w3").count() == 19


def test_pages_are_extracted_once(spark, monkeypatch):
    from lyrebird.operators import index as module

    staged_plans = []
    real = module.staged
    monkeypatch.setattr(module, "staged", lambda df, name="table", by=None: staged_plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, name, by))
    build(spark.createDataFrame([(1, "u", "<p>red")], "page_id bigint, url string, html_content string"))
    assert sum("regexp_replace" in p for p in staged_plans) == 1
