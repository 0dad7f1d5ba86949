"""Queries of the engine's operators over the test tables, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird import fixtures
from lyrebird.functions import url as U
from lyrebird.functions.stem import stem_sql, stemmed
from lyrebird.functions.text import LOWER, STOP_WORDS, UPPER, content_hash, extract_text, extract_title, html_escape, tokens, url_decode
from lyrebird.operators import corpus, crawl
from lyrebird.operators import search as S
from lyrebird.operators.index import Index, build
from lyrebird.plans.query import parse, set_sql
from lyrebird.plans.staging import shared_path, staged
from lyrebird.operators.waves import crawl as run_crawl
from lyrebird.sources.index_store import open_index, read_documents, write_index
from lyrebird.sources.reports import write_rank_table
from lyrebird.streaming.ingest import Store, ingest, read_landing

#: Pages fetched from here on are the new crawl, those before it the store.
CUT = 1700035200
NOW = 1700700000
QUERY = {
    "search_term": "концерт",
    "search_and": "концерт && музыка",
    "search_implicit_and": "concert music",
    "search_or": "концерт || concert",
    "search_not": "!музыка",
    "search_nested": "(концерт || concert) && !(музыка || music)",
    "search_double_not": "!!опера",
    "search_missing_term": "nosuchterm",
    "search_never_matching": "foo-bar || опера",
}
BATCH = ["опера", "опера && !музыка", "the || der", "!и", "a-b", "|| x", "концерт (музыка || опера)"]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "crawled")


_indexes: dict[tuple[str, str], Index] = {}


def index(spark: SparkSession, sf: str) -> Index:
    """The index of the crawled pages, built once for each application and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _indexes:
        _indexes[key] = build(_pages(spark, sf))
    return _indexes[key]


def _build(spark: SparkSession, sf: str) -> DataFrame:
    """A new index, which the other queries then use, and its statistics."""
    key = (spark.sparkContext.applicationId, sf)
    _indexes[key] = build(_pages(spark, sf))
    return _indexes[key].stats


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """A nested Boolean search over a new index of the crawled pages."""
    return S.matches(build(_pages(spark, sf)), QUERY["search_or"])


def _search(name: str):
    return lambda spark, sf: S.matches(index(spark, sf), QUERY[name])


def _by_sets(spark: SparkSession, sf: str) -> DataFrame:
    return S.matches_by_sets(index(spark, sf), QUERY["search_nested"])


def _totals(spark: SparkSession, sf: str) -> DataFrame:
    found = [S.total(S.matches(index(spark, sf), q), q) for q in ("опера", "nosuchterm", "|| x", "!музыка")]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _title(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("page_id", extract_title("html_content").alias("title"))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.links(_pages(spark, sf), keep=["page_id"])


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = _pages(spark, sf).withColumn("content_hash", content_hash("html_content"))
    return p.where(F.col("crawl_date") < CUT), p.where(F.coalesce(F.col("crawl_date") >= CUT, F.lit(True)))


def _upsert(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.upsert(*_halves(spark, sf)).select("url", "action", "crawl_date", "content_hash", "source_name")


def _frontier(spark: SparkSession, sf: str) -> DataFrame:
    queue = crawl.restored_queue(_pages(spark, sf).where(U.is_valid("url")), NOW)
    return queue.unionByName(crawl.seeds(_t(spark, sf, "sources"), _pages(spark, sf), NOW))


def _bfs(spark: SparkSession, sf: str) -> DataFrame:
    """A crawl that starts from all stored pages, whose links are followed, and finds its pages in the store, by normal URL."""
    store = staged(_pages(spark, sf).where(F.length("html_content") > 0).select(U.normalize_url("url").alias("url"), "html_content", "source_name"), "store")
    start = store.where("url <> ''").groupBy("url").agg(F.min("source_name").alias("source_name"))
    return crawl.breadth_first(start, lambda level: store.join(level.select("url"), "url", "left_semi").select("url", "html_content"), max_depth=2)


def _crawl_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The figures of the crawl of ``crawl_bfs``: links that lead out of the store fail."""
    return crawl.crawl_stats(_bfs(spark, sf), _pages(spark, sf).where(F.length("html_content") > 0).select(U.normalize_url("url").alias("url")))


def _url_rules(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.createDataFrame([(u,) for u, *_ in fixtures.URLS], "url string")
    return df.select("url", U.is_file("url").alias("file"), U.is_article("url").alias("article"), U.is_closed_path("url").alias("closed"))


def _escapes(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t, _ in fixtures.ESCAPES], "text string").select("text", url_decode("text").alias("decoded"))


def _gates(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(u, r) for u, r, _ in fixtures.GATES], "url string, respect boolean")
    robots = spark.createDataFrame([(h, fixtures.ROBOTS) for h in ("music.example", "en.wikipedia.org", "ru.wikipedia.org")], "domain string, robots_txt string")
    strict, loose = (crawl.allowed(rows.where(F.col("respect") == F.lit(r)), robots, respect=r) for r in (True, False))
    return strict.unionByName(loose)


def _responses_rules(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.createDataFrame([(s, a) for s, a, *_ in fixtures.RESPONSES], "status int, attempt int")
    return df.select("status", "attempt", crawl.fetch_action(F.col("status"), F.col("attempt")).alias("action"), crawl.retry_wait(F.col("status"), F.col("attempt")).alias("wait"))


def _delays(spark: SparkSession, sf: str) -> DataFrame:
    found = None
    for configured in sorted({c for _, c, _ in fixtures.DELAYS}):
        df = spark.createDataFrame([(a, c) for a, c, _ in fixtures.DELAYS if c == configured], "asked double, configured double")
        part = df.select("asked", "configured", crawl.crawl_delay(F.col("asked"), configured).alias("delay"))
        found = part if found is None else found.unionByName(part)
    return found


def _run_crawl(spark: SparkSession, sf: str) -> DataFrame:
    """A crawl of the small web from settings to store, without waiting."""
    store = Store(spark, shared_path(spark, "crawl"), parts=4)
    logic = {"sources": [{"name": "h", "url": "HTTP://h/s#top"}], "max_depth": 3, "max_pages": 0, "recheck_interval_days": 7}
    counts = run_crawl(spark, logic, store, fixtures.web, sleep=lambda s: None)
    figures = [F.lit(counts[k]).cast("bigint").alias(k) for k in ("asked", "failed", "barred")]
    return store.current().select("url", "source_name", F.col("content_hash"), *figures)


def _trees(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(q, str(parse(q))) for q, _ in fixtures.TREES], "query string, tree string")


def _rank_table(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of a rank table written and read again."""
    path = shared_path(spark, "ranktable")
    write_rank_table(_ranks(spark, sf), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def _imported(spark: SparkSession, sf: str) -> DataFrame:
    """The pages written as JSON lines and read as documents."""
    path = shared_path(spark, "documents") + ".jsonl"
    _pages(spark, sf).select("url", "html_content").write.json(path)
    return read_documents(spark, path).select("url", content_hash("html_content").alias("hash"))


def _freq(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.token_frequencies(_pages(spark, sf))


def _ranks(spark: SparkSession, sf: str) -> DataFrame:
    return staged(corpus.ranked(corpus.token_frequencies(_pages(spark, sf), stop_words=None, numbers=True)), "ranks")


def _fit(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.mandelbrot_fit(_ranks(spark, sf)).select(*(F.round(c, 4).alias(c) for c in ("b", "rho", "p", "error")))


def _stem_golden(spark: SparkSession, sf: str) -> DataFrame:
    words = [w for w, _ in STEMS]
    return stemmed(spark.createDataFrame([(w,) for w in words], "word string"))


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    """The search log with its repeats taken out: the last received row of each hit, and each query's hits."""
    log = _t(spark, sf, "search_results")
    last = log.groupBy("query_id", "hit_no").agg(F.max(F.struct("received_at", "doc_id")).alias("l"))
    return last.groupBy("query_id").agg(F.count("*").alias("hits"), F.countDistinct("l.doc_id").alias("pages"))


def _json(spark: SparkSession, sf: str) -> DataFrame:
    return S.response_json(S.matches(index(spark, sf), "опера"), "опера", limit=10)


def _inverted(spark: SparkSession, sf: str) -> DataFrame:
    return index(spark, sf).inverted().select("term", "df", F.array_join(F.transform("postings", lambda x: x.cast("string")), " ").alias("postings"))


def _stored_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A search in an index written to the shared folder and opened again."""
    path = shared_path(spark, "index")
    write_index(index(spark, sf), path)
    return S.matches(open_index(spark, path), QUERY["search_and"])


def _stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The upsert by Structured Streaming: the store's half and the crawl's half as two files of a landing folder."""
    base = shared_path(spark, "stream")
    old, new = _halves(spark, sf)
    cols = ["url", "html_content", "source_name", "crawl_date"]
    old.select(*cols).write.parquet(f"{base}/landing/a")
    new.select(*cols).write.parquet(f"{base}/landing/b")
    store = Store(spark, f"{base}/store")
    for number, part in enumerate(("a", "b")):
        stream = read_landing(spark, f"{base}/landing/{part}", "url string, html_content string, source_name string, crawl_date bigint", 1000)
        ingest(stream, store, f"{base}/check-{part}", first=number).awaitTermination()
    return store.current().select("url", "action", "crawl_date", "content_hash", "source_name")


STEMS = [
    ("музыкант", "музыкант"), ("музыканты", "музыкант"), ("музыкантами", "музыкант"), ("певица", "певиц"), ("певцы", "певц"),
    ("русский", "русск"), ("русская", "русск"), ("написавший", "написавш"), ("прочитавши", "прочита"), ("читая", "чит"),
    ("поёт", "поёт"), ("смеяться", "смея"), ("новейший", "нов"), ("день", "ден"), ("радость", "радост"), ("известность", "известн"),
    ("области", "област"), ("длинный", "длин"), ("пою", "по"), ("я", "я"), ("он", "он"), ("the", "the"), ("vst123", "vst123"),
    ("а1б", "а1б"), ("концертах", "концерт"), ("играл", "игра"), ("играла", "игра"), ("учитель", "учител"),
]

QUERIES = {
    "extract_text": lambda s, d: _pages(s, d).select("page_id", extract_text("html_content").alias("text")),
    "extract_title": _title,
    "tokenize_counts": lambda s, d: _pages(s, d).select("page_id", tokens(extract_text("html_content")).alias("t")).select("page_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct")).where("n_tokens >= 0"),
    "tokenize_docs": lambda s, d: _t(s, d, "documents").where("text is not null").select("doc_id", F.size(tokens("text")).cast("bigint").alias("n_tokens")),
    "case_sensitive_tokens": lambda s, d: _t(s, d, "documents").where("text is not null").select(F.explode(tokens("text", lowercase=False)).alias("term")).groupBy("term").agg(F.count("*").alias("cnt")),
    "stopword_filtered_freq": _freq,
    "byte_lengths": lambda s, d: _pages(s, d).select("page_id", F.octet_length("html_content").cast("bigint").alias("n_bytes")),
    "html_escaped": lambda s, d: _t(s, d, "docinfo").select("doc_id", html_escape("title").alias("title")),
    "url_decoded": lambda s, d: _t(s, d, "docinfo").select("doc_id", url_decode("url").alias("url")),
    "forward_index": lambda s, d: index(s, d).docs.select("doc_id", "title", "url"),
    "postings": lambda s, d: index(s, d).postings,
    "inverted_index": _inverted,
    "inverted_blocks": lambda s, d: index(s, d).blocks(100).select("term", "block", "df", F.array_join(F.transform("postings", lambda x: x.cast("string")), " ").alias("postings")),
    "index_build": _build,
    "index_stats": lambda s, d: index(s, d).stats,
    **{name: _search(name) for name in QUERY},
    "search_by_sets": _by_sets,
    "search_total_count": _totals,
    "search_paged": lambda s, d: S.page_of(S.matches(index(s, d), "концерт || concert"), 2, 5),
    "search_page_zero": lambda s, d: S.page_of(S.matches(index(s, d), "концерт"), 0, 5).agg(F.count("*").alias("n")),
    "search_batch": lambda s, d: S.batch(index(s, d), BATCH).select("query", "doc_id"),
    "search_json": _json,
    "search_stored": _stored_lookup,
    "search_log": _responses,
    "top_tokens": lambda s, d: corpus.top(_freq(s, d), 100),
    "top_stems": lambda s, d: corpus.top(corpus.stem_frequencies(_freq(s, d)), 100, "stem"),
    "rank_table": _rank_table,
    "query_trees": _trees,
    "document_count": lambda s, d: _pages(s, d).agg(F.count("*").alias("documents")),
    "documents_imported": _imported,
    "rank_frequency": lambda s, d: corpus.ranked(_freq(s, d)),
    "zipf_theoretical": lambda s, d: corpus.zipf(_ranks(s, d)).select("rank", F.round("theoretical", 4).alias("theoretical")),
    "mandelbrot_theoretical": lambda s, d: corpus.mandelbrot(_ranks(s, d)).select("rank", F.round("theoretical", 4).alias("theoretical")),
    "mandelbrot_fit": _fit,
    "zipf_deviation": lambda s, d: corpus.deviation(corpus.zipf(_ranks(s, d))),
    "corpus_stats": lambda s, d: corpus.corpus_stats(_pages(s, d)),
    "stem_golden": _stem_golden,
    "stem_freq": lambda s, d: corpus.stem_frequencies(_freq(s, d)),
    "url_normalize": lambda s, d: _pages(s, d).select("page_id", U.normalize_url("url").alias("norm"), U.domain("url").alias("domain"), U.is_valid("url").alias("valid")),
    "url_kinds": lambda s, d: _pages(s, d).where("url is not null").select("page_id", U.is_file("url").alias("file"), U.is_article("url").alias("article"), U.is_closed_path("url").alias("closed")),
    "link_graph": lambda s, d: _links(s, d).select("page_id", "link"),
    "same_domain_links": lambda s, d: _links(s, d).where(U.same_domain("link", "url")).groupBy("page_id").agg(F.count("*").alias("links")),
    "content_hash_dedup": lambda s, d: crawl.copies(_t(s, d, "documents"), "text"),
    "content_hash_check": lambda s, d: crawl.with_hash(_pages(s, d).select("page_id", "html_content", F.lower("content_hash").alias("stored"))).select("page_id", (F.col("stored") == F.col("content_hash")).alias("fresh")),
    "crawl_upsert": _upsert,
    "crawl_upsert_stream": _stream_upsert,
    "recheck_due": lambda s, d: _pages(s, d).select("page_id", crawl.recheck_due(F.col("crawl_date"), NOW).alias("due")),
    "visited": lambda s, d: crawl.visited(_pages(s, d)),
    "crawl_seeds": lambda s, d: crawl.seeds(_t(s, d, "sources"), _pages(s, d), NOW),
    "crawl_frontier": _frontier,
    "crawl_bfs": _bfs,
    "crawl_stats": _crawl_stats,
    "crawl_run": _run_crawl,
    "crawl_gates": _gates,
    "crawl_delays": _delays,
    "fetch_outcomes": _responses_rules,
    "url_rules": _url_rules,
    "url_escapes": _escapes,
}

_V = f"'{UPPER}', '{LOWER}'"
_TEXT = r"regexp_replace(regexp_replace(regexp_replace({}, '(?is)<script.*?(?:</script[^>]*>|\z)|<style.*?(?:</style[^>]*>|\z)|<[^>]*(?:>|\z)|>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), '^ ', '')"
_TOKENS = "regexp_extract_all(translate({}, " + _V + "), '[a-z0-9а-яё]{{2,}}')"
_PAGE_TOKENS = _TOKENS.format(_TEXT.format("html_content"))
_TITLE = f"""
low as (select *, coalesce(html_content, '') as h, translate(coalesce(html_content, ''), '{UPPER[:26]}', '{LOWER[:26]}') as l from crawled),
pos as (select *, case when strpos(l, '<title>') > 0 then strpos(l, '<title>') else strpos(l, '<title ') end as ts, strpos(l, '<h1') as hs from low),
gt as (select *, case when ts > 0 and strpos(substr(h, ts), '>') > 0 then ts + strpos(substr(h, ts), '>') end as t0,
  case when hs > 0 and strpos(substr(h, hs), '>') > 0 then hs + strpos(substr(h, hs), '>') end as h0 from pos),
fin as (select *, case when strpos(substr(l, t0), '</title>') > 0 then substr(h, t0, strpos(substr(l, t0), '</title>') - 1) end as t,
  case when strpos(substr(l, h0), '</h1>') > 0 then substr(h, h0, strpos(substr(l, h0), '</h1>') - 1) end as hd from gt),
titles as (select page_id, url, html_content, coalesce(split_part(split_part(t, ' — ', 1), ' - ', 1), {_TEXT.format("hd")}, 'Untitled') as title from fin)"""
_INDEX = f"""with {_TITLE},
docs as (select row_number() over (order by page_id) - 1 as doc_id, title, coalesce(url, '') as url, {_TEXT.format("html_content")} as text from titles where html_content <> ''),
toks as (select *, {_TOKENS.format("text")} as t from docs),
postings as (select distinct doc_id, unnest(t) as term from toks)
"""
_NORMAL = r"""
parts as (select *, regexp_replace(url, '#.*$', '') as u from {source}),
cut as (select *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme, lower(regexp_extract(u, '^[^:/?#]+://([^/?#]*)', 1)) as host,
  regexp_replace(url_decode(regexp_extract(u, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)), '/+', '/', 'g') as path, regexp_extract(u, '[?](.*)$', 1) as query from parts),
normal as (select *, coalesce(scheme || '://' || host || case when length(path) > 1 then regexp_replace(path, '/$', '') else path end
  || case when query <> '' then '?' || list_aggregate(list_sort(string_split(query, '&')), 'string_agg', '&') else '' end, '') as norm from cut)"""
_ENDINGS = "|".join(e[1:] for e in U.FILE_ENDINGS)
_LINKS = f"""with hrefs as (select page_id, url as page, unnest(regexp_extract_all(regexp_replace(html_content, '(?is)<script.*?</script[^>]*>|<!--.*?-->', '', 'g'),
    '<[aA]\\s[^>]*?[hH][rR][eE][fF]=["'']?([^"''>\\s]*)', 1)) as href from crawled where html_content <> ''),
based as (select page_id, page, regexp_extract(page, '^[^:/?#]+://[^/?#]*') || href as url from hrefs where page is not null and starts_with(href, '/') and not starts_with(href, '//')
  union all select page_id, page, href from hrefs where regexp_matches(href, '^[a-z]+://')),
{_NORMAL.format(source="based")},
links as (select page_id, norm as link, page from normal where not regexp_matches(lower(norm), '[.]({_ENDINGS})') and not regexp_matches(norm, '/(File|Файл):|/wiki/(Media|Медиа):'))
"""
_FRESH = f"fresh as (select url from (select url, max(crawl_date) as d from crawled where url is not null group by 1) where {NOW} - d <= 7 * 86400)"
_FREQ = f"""with words as (select unnest({_PAGE_TOKENS}) as token from crawled where html_content <> ''),
freq as (select token, count(*) as cnt from words where not regexp_full_match(token, '[0-9]+') and token not in ({", ".join(f"'{w}'" for w in STOP_WORDS)}) group by 1)
"""
_RANKS = f"""with words as (select unnest({_PAGE_TOKENS}) as token from crawled where html_content <> ''),
freq as (select token, count(*) as cnt from words group by 1),
ranks as (select row_number() over (order by cnt desc, token) as rank, cnt, token from freq)
"""
_GRID = ", ".join(f"({i}, {b!r}::double, {r!r}::double)" for i, (b, r) in enumerate(corpus.grid()))
_ZIPF = "select rank, cnt, sum(cnt) over () / sum(1.0 / rank::double) over () / rank::double as theoretical from ranks"


def _literal(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool | int | float):
        return repr(value).lower()
    return "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple], columns: str) -> str:
    """The rows as a table of fixed values."""
    return "select * from (values " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") t({columns})"


def _contains(where: str, parts: list[str]) -> str:
    return "(" + " or ".join(f"contains({where}, {_literal(x)})" for x in parts) + ")"


def _either(parts: list[str]) -> str:
    return f"({_contains('url', parts)} or {_contains('d', parts)})"


_GENERAL = " or ".join([_either([x for x in U.CLOSED if x not in U.CLOSED_BUT])] + [f"({_either([x])} and not {_contains('url', but)})" for x, but in U.CLOSED_BUT.items()])
_KINDS = f"""with urls as (select page_id, url, url_decode(url) as d, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) as host from crawled where url is not null),
ruled as (select *, regexp_matches(lower(url), '[.]({_ENDINGS})') or regexp_matches(url, '/(File|Файл):|/wiki/(Media|Медиа):') as file,
  contains(host, 'wikipedia.org') and ({_GENERAL} or (contains(host, 'ru.wikipedia.org') and ({_either(U.CLOSED_RU)} or (contains(d, '{U.PROJECT}') and not {_contains('d', U.PROJECT_OPEN)})))) as closed from urls)
select page_id, file, contains(host, 'wikipedia.org') and not file and not closed and contains(url, '/wiki/') and not {_either(U.NO_ARTICLE)} as article, closed from ruled"""
_BFS = _LINKS + f""", {_NORMAL.format(source="pages").replace("parts as", "parts3 as").replace("from parts)", "from parts3)").replace("cut as", "cut3 as").replace("from cut)", "from cut3)").replace("normal as", "stored as")},
l0 as (select norm as url, min(source_name) as source_name from stored where norm <> '' group by 1),
edges as (select s.norm as url, l.link from links l join stored s using (page_id)
  where s.norm <> '' and lower(regexp_extract(l.link, '^[^:/?#]+://([^/?#]*)', 1)) = lower(regexp_extract(s.norm, '^[^:/?#]+://([^/?#]*)', 1))),
l1 as (select link as url, min(source_name) as source_name from edges join l0 using (url) where link not in (select url from l0) group by 1),
l2 as (select link as url, min(source_name) as source_name from edges join l1 using (url) where link not in (select url from l0) and link not in (select url from l1) group by 1),
bfs as (select url, source_name, 0::int as depth from l0 union all select url, source_name, 1 from l1 union all select url, source_name, 2 from l2)
"""
_BFS = _BFS.replace("with hrefs as", "with pages as (select * from crawled where html_content <> ''), hrefs as", 1)


def _found_sql(query: str) -> str:
    return _INDEX + f"select doc_id, title, url from docs where doc_id in ({set_sql(parse(query))})"


_HALVES = f"""with fetched as (select url, html_content, source_name, crawl_date, sha256(html_content) as content_hash, coalesce(crawl_date >= {CUT}, true) as new from crawled where url is not null),
last as (select *, row_number() over (partition by url, new order by crawl_date desc nulls last, content_hash desc nulls last, html_content desc nulls last, source_name desc nulls last) as rn from fetched),
o as (select * from last where rn = 1 and not new), n as (select * from last where rn = 1 and new),
b as (select coalesce(o.url, n.url) as url, case when n.url is null then 'kept' when o.url is null then 'inserted' when o.content_hash = n.content_hash then 'dated' else 'replaced' end as action,
  o.crawl_date as od, n.crawl_date as nd, o.content_hash as oh, n.content_hash as nh, o.source_name as os, n.source_name as ns from o full join n on o.url = n.url)
select url, action, case action when 'kept' then od else nd end as crawl_date, case when action in ('inserted', 'replaced') then nh else oh end as content_hash,
  case when action in ('inserted', 'replaced') then ns else os end as source_name from b"""

_STATS = _INDEX + """select (select count(*) from toks) as total_documents, (select sum(len(t))::bigint from toks) as total_tokens,
  (select sum(strlen(text))::bigint from toks) as total_text_bytes, (select count(distinct term) from postings) as unique_terms,
  (select count(*) from postings) as total_postings, (select round(avg(strlen(term)), 6) from (select distinct term from postings)) as avg_term_length"""

ORACLE = {
    "extract_text": f"select page_id, {_TEXT.format('html_content')} as text from crawled",
    "extract_title": f"with {_TITLE} select page_id, title from titles",
    "tokenize_counts": f"with t as (select page_id, {_PAGE_TOKENS} as t from crawled where html_content is not null) select page_id, len(t)::bigint as n_tokens, len(list_distinct(t))::bigint as n_distinct from t",
    "tokenize_docs": f"select doc_id, len({_TOKENS.format('text')})::bigint as n_tokens from documents where text is not null",
    "case_sensitive_tokens": "select term, count(*) as cnt from (select unnest(regexp_extract_all(text, '[A-Za-z0-9А-Яа-яЁё]{2,}')) as term from documents) group by 1",
    "stopword_filtered_freq": _FREQ + "select token, cnt from freq",
    "byte_lengths": "select page_id, strlen(html_content)::bigint as n_bytes from crawled",
    "html_escaped": "select doc_id, replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as title from docinfo",
    "forward_index": _INDEX + "select doc_id, title, url from docs",
    "postings": _INDEX + "select term, doc_id from postings",
    "inverted_index": _INDEX + "select term, count(*) as df, string_agg(doc_id::varchar, ' ' order by doc_id) as postings from postings group by 1",
    "inverted_blocks": _INDEX + "select term, doc_id // 100 as block, count(*) as df, string_agg(doc_id::varchar, ' ' order by doc_id) as postings from postings group by all",
    "index_build": _STATS,
    "index_stats": _STATS,
    **{name: _found_sql(q) for name, q in QUERY.items()},
    "search_by_sets": _found_sql(QUERY["search_nested"]),
    "search_stored": _found_sql(QUERY["search_and"]),
    "search_total_count": _INDEX + " union all ".join(f"select '{q}' as query, count(*) as total_count from ({set_sql(parse(q))})" for q in ("опера", "nosuchterm", "|| x", "!музыка")),
    "search_paged": _found_sql("концерт || concert") + " order by doc_id limit 5 offset 5",
    "search_page_zero": "select 0::bigint as n",
    "search_batch": _INDEX + " union all ".join(f"select '{q}' as query, doc_id from ({set_sql(parse(q))})" for q in BATCH),
    "search_log": """with last as (select *, row_number() over (partition by query_id, hit_no order by received_at desc, doc_id desc) as rn from search_results)
select query_id, count(*) as hits, count(distinct doc_id) as pages from last where rn = 1 group by 1""",
    "top_tokens": _FREQ + "select row_number() over (order by cnt desc, token) as rank, token, cnt from freq order by cnt desc, token limit 100",
    "rank_frequency": _FREQ + "select row_number() over (order by cnt desc, token) as rank, cnt, token as term from freq",
    "zipf_theoretical": _RANKS + f"select rank, round(theoretical, 4) as theoretical from ({_ZIPF})",
    "mandelbrot_theoretical": _RANKS + "select rank, round(sum(cnt) over () * pow(rank + 2.7, -1.0) / sum(pow(rank + 2.7, -1.0)) over (), 4) as theoretical from ranks",
    "mandelbrot_fit": _RANKS + f""", grid(i, b, rho) as (values {_GRID}),
norms as (select i, b, rho, sum(pow(rank + rho, -b)) as norm, sum(cnt) as total from ranks, grid group by all),
errors as (select i, b, rho, avg(pow(ln(cnt + 1) - ln(pow(rank + rho, -b) / norm * total + 1), 2)) as error, max(cnt) as first from ranks, norms where rank <= 1000 group by all)
select round(b, 4) as b, round(rho, 4) as rho, round(first * pow(1 + rho, b), 4) as p, round(error, 4) as error from errors order by errors.error, i limit 1""",
    "zipf_deviation": _RANKS + f"""select case when rank <= 10 then 1 when rank <= 100 then 2 when rank <= 1000 then 3 else 4 end as zone,
  round(avg(abs(cnt - theoretical) / theoretical) * 100, 1) as pct, case when sum(cnt) > sum(theoretical) then 'above' else 'below' end as direction from ({_ZIPF}) group by 1""",
    "corpus_stats": _FREQ + f""", {stem_sql("freq", "token")}
select (select count(*) from crawled) as total_documents, (select sum(strlen(html_content))::bigint from crawled) as total_bytes, (select sum(cnt)::bigint from freq) as total_tokens,
  (select count(*) from freq) as unique_tokens, (select round(sum(cnt * length(token)) / sum(cnt), 6) from freq) as avg_token_length, (select count(distinct stem) from stems) as unique_stems""",
    "stem_golden": "select * from (values " + ", ".join(f"('{w}', '{s}')" for w, s in STEMS) + ") t(word, stem)",
    "stem_freq": _FREQ + f", {stem_sql('freq', 'token')} select stem, sum(cnt)::bigint as cnt from freq join stems on token = word group by 1",
    "url_decoded": "select doc_id, url_decode(replace(url, '+', ' ')) as url from docinfo",
    "url_normalize": f"with {_NORMAL.format(source='crawled')} select page_id, norm, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) as domain, coalesce(regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+'), false) as valid from normal",
    "url_kinds": _KINDS,
    "url_rules": _values(fixtures.URLS, "url, file, article, closed"),
    "url_escapes": _values(fixtures.ESCAPES, "text, decoded"),
    "crawl_gates": _values(fixtures.GATES, "url, respect, allowed"),
    "fetch_outcomes": "select status::int as status, attempt::int as attempt, action, wait::double as wait from (" + _values(fixtures.RESPONSES, "status, attempt, action, wait") + ")",
    "crawl_delays": "select asked::double as asked, configured::double as configured, delay::double as delay from (" + _values(fixtures.DELAYS, "asked, configured, delay") + ")",
    "crawl_run": "select url, 'h' as source_name, sha256(html) as content_hash, 6::bigint as asked, 1::bigint as failed, 1::bigint as barred from ("
    + _values([(u, fixtures.web(u)[1]) for u in fixtures.REACHED], "url, html") + ")",
    "query_trees": _values(fixtures.TREES, "query, tree"),
    "crawl_bfs": _BFS + "select url, source_name, depth from bfs",
    "crawl_stats": _BFS + "select count(*) as crawled, count(*) as saved, count(*) filter (where url not in (select norm from stored)) as failed from bfs",
    "document_count": "select count(*) as documents from crawled",
    "documents_imported": "select coalesce(url, '') as url, sha256(coalesce(html_content, '')) as hash from crawled",
    "rank_table": _RANKS + "select '# Rank\tFrequency\tTerm' as line union all select rank || chr(9) || cnt || chr(9) || token from ranks",
    "top_stems": _FREQ + f", {stem_sql('freq', 'token')}, summed as (select stem, sum(cnt)::bigint as cnt from freq join stems on token = word group by 1) select row_number() over (order by cnt desc, stem) as rank, stem, cnt from summed order by cnt desc, stem limit 100",
    "link_graph": _LINKS + "select page_id, link from links",
    "same_domain_links": _LINKS + "select page_id, count(*) as links from links where lower(regexp_extract(link, '^[^:/?#]+://([^/?#]*)', 1)) = lower(regexp_extract(page, '^[^:/?#]+://([^/?#]*)', 1)) group by 1",
    "crawl_seeds": f"with {_NORMAL.format(source='sources')}, {_FRESH} select norm as url, name as source_name, 0::int as depth from normal where enabled and norm not in (select url from fresh)",
    "crawl_frontier": _LINKS + f""", {_FRESH}, {_NORMAL.format(source="sources").replace("parts", "parts2").replace("cut", "cut2").replace("normal as", "seeds as")}
select link as url, min(coalesce(source_name, 'Unknown')) as source_name, 1::int as depth from links join crawled using (page_id)
where lower(regexp_extract(link, '^[^:/?#]+://([^/?#]*)', 1)) = lower(regexp_extract(page, '^[^:/?#]+://([^/?#]*)', 1)) and link not in (select url from fresh) group by 1
union all select norm, name, 0 from seeds where enabled and norm not in (select url from fresh)""",
    "search_json": _INDEX + f"""select to_json({{query: 'опера', total: (select count(*) from ({set_sql(parse('опера'))})),
  results: (select list({{title: title, url: url}} order by doc_id) from (select * from docs where doc_id in ({set_sql(parse('опера'))}) order by doc_id limit 10))}})::varchar as json""",
    "content_hash_dedup": "select sha256(text) as hash, count(*) as n from documents where text is not null group by 1",
    "content_hash_check": "select page_id, lower(content_hash) = sha256(html_content) as fresh from crawled",
    "crawl_upsert": _HALVES,
    "crawl_upsert_stream": _HALVES,
    "recheck_due": f"select page_id, coalesce({NOW} - crawl_date > 7 * 86400, true) as due from crawled",
    "visited": "select url, max(crawl_date) as crawl_date from crawled where url is not null group by 1",
}
