"""Boolean search over an index: the fused plan, the plan of set operations, batches, pages, responses."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.operators.index import Index
from lyrebird.plans.query import And, Node, Not, Or, Term, can_match, compiled, fold, holds, parse, terms

RESULT = ["doc_id", "title", "url"]


def _none(index: Index) -> DataFrame:
    return index.docs.select(*RESULT).where(F.lit(False))


def _flagged(index: Index, wanted: list[str]) -> DataFrame:
    """(doc_id, f0, f1, ...): which of the terms each document with any of them has; one scan of the postings."""
    hits = index.postings.where(F.col("term").isin(wanted))
    return hits.groupBy("doc_id").agg(*(F.bool_or(F.col("term") == t).alias(f"f{i}") for i, t in enumerate(wanted)))


def matches(index: Index, query: str | Node | None) -> DataFrame:
    """(doc_id, title, url) of the documents for which the query holds, in no order: one scan of the postings, one
    aggregation and one join, whatever the tree. If a document without any of the terms can't match, the join is inner;
    else documents without hits are kept."""
    node = parse(query) if isinstance(query, str) or query is None else query
    if node is None:
        return _none(index)
    wanted = terms(node)
    if not wanted:
        return index.docs.select(*RESULT) if holds(node, {}) else _none(index)
    at = {t: i for i, t in enumerate(wanted)}
    flags = _flagged(index, wanted)
    truth = compiled(node, lambda t: F.coalesce(F.col(f"f{at[t]}"), F.lit(False)))
    if not holds(node, {}):
        return index.docs.join(flags.where(truth), "doc_id").select(*RESULT)
    return index.docs.join(flags, "doc_id", "left").where(truth).select(*RESULT)


def matches_by_sets(index: Index, query: str | Node | None) -> DataFrame:
    """The same rows by intersection, union and difference of posting sets, one scan for each term."""
    node = parse(query) if isinstance(query, str) or query is None else query
    if node is None:
        return _none(index)
    every = index.docs.select("doc_id")

    def of(n: Node) -> DataFrame:
        if isinstance(n, Term):
            return index.postings.where(F.col("term") == fold(n.text)).select("doc_id") if can_match(n) else every.where(F.lit(False))
        if isinstance(n, Not):
            return every.exceptAll(of(n.operand).distinct())
        parts = [of(o) for o in n.operands]
        if isinstance(n, And):
            return reduce(lambda a, b: a.intersect(b), parts)
        assert isinstance(n, Or)
        return reduce(lambda a, b: a.union(b), parts).distinct()

    return index.docs.join(of(node), "doc_id", "left_semi").select(*RESULT)


def paged(found: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """The rows from ``offset`` on, at most ``limit``, by ascending doc_id."""
    ordered = found.orderBy("doc_id")
    return (ordered.offset(offset) if offset > 0 else ordered).limit(max(0, limit))


def page_of(found: DataFrame, page: int, limit: int = 50) -> DataFrame:
    """A page by its number from 1; a number below 1 gives an empty page."""
    return paged(found, limit, (page - 1) * limit) if page >= 1 else found.where(F.lit(False))


def page_count(total: int, limit: int = 50) -> int:
    """Pages of a result, at least one."""
    return max(1, -(-total // limit))


def total(found: DataFrame, query: str) -> DataFrame:
    """(query, total_count): all matches, before any limit."""
    return found.agg(F.count("*").alias("total_count")).select(F.lit(query).alias("query"), "total_count")


def batch(index: Index, queries: list[str]) -> DataFrame:
    """(query_no, query, doc_id) for several queries, numbered from 0; blank queries are left out.

    All terms are looked up in one scan and one aggregation. Queries that only documents with a hit can match are
    evaluated together on those documents; the rest on all documents, again together."""
    numbered = [(i, q, parse(q)) for i, q in enumerate(q for q in queries if q.strip())]
    wanted = list(dict.fromkeys(t for _, _, n in numbered for t in terms(n)))
    at = {t: i for i, t in enumerate(wanted)}
    flags = _flagged(index, wanted) if wanted else index.docs.where(F.lit(False)).select("doc_id")
    parts = []
    for positive in (True, False):
        some = [(i, q, n) for i, q, n in numbered if n is not None and holds(n, {}) != positive]
        if not some:
            continue
        base = flags if positive else index.docs.select("doc_id").join(flags, "doc_id", "left")
        hits = [
            F.when(compiled(n, lambda t: F.coalesce(F.col(f"f{at[t]}"), F.lit(False))), F.struct(F.lit(i).alias("query_no"), F.lit(q).alias("query")))
            for i, q, n in some
        ]
        parts.append(base.select("doc_id", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("h.query_no", "h.query", "doc_id"))
    if not parts:
        return index.docs.where(F.lit(False)).select(F.lit(0).alias("query_no"), F.lit("").alias("query"), "doc_id")
    return reduce(DataFrame.unionByName, parts)


def response_json(found: DataFrame, query: str, limit: int = 50, page: int = 1) -> DataFrame:
    """One row, one column ``json``: query, total, and the title and url of one page of the results, properly escaped.
    The list holds at most ``limit`` rows."""
    rows = page_of(found, page, limit).agg(F.sort_array(F.collect_list(F.struct("doc_id", "title", "url"))).alias("r"))
    whole = total(found, query).crossJoin(rows)  # one row by one row
    results = F.transform("r", lambda x: F.struct(x.title.alias("title"), x.url.alias("url")))
    return whole.select(F.to_json(F.struct(F.col("query"), F.col("total_count").alias("total"), results.alias("results"))).alias("json"))


@dataclass
class Response:
    query: str
    total_count: int
    query_time_ms: float
    results: list


def search(index: Index, query: str, limit: int = 50, offset: int = 0) -> Response:
    """A page of results with the total and the time taken."""
    began = time.perf_counter()
    found = matches(index, query)
    if parse(query) is None:
        return Response(query, 0, 0.0, [])
    n = found.count()
    rows = paged(found, limit, offset).collect()  # at most limit rows
    return Response(query, n, (time.perf_counter() - began) * 1000, rows)
