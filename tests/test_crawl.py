import pytest
from pyspark.sql import functions as F

from lyrebird.functions.url import domain, is_article, is_closed_path, is_file, is_valid, normal_url
from lyrebird.operators.crawl import allowed, breadth_first, copies, crawl_delay, crawl_stats, fetch_action, hrefs_of, links, recheck_due, restored_queue, retry_wait, seeds, upsert, visited

BASE = "http://h.example.com/fr/825?page=2"
URLS = [
    ("HTTP://EX.com//a//b/?b=2&a=1#f", None, "http://ex.com/a/b?a=1&b=2"),
    ("http://ex.com", None, "http://ex.com"),
    ("http://ex.com/", None, "http://ex.com/"),
    ("http://ex.com:80/x%20y/", None, "http://ex.com:80/x y"),
    ("http://ex.com/p?b=&a=2&a=1&c", None, "http://ex.com/p?a=2&a=1&b=&c="),
    ("mailto:a@b.c", None, "mailto:a@b.c"),
    ("/The", BASE, "http://h.example.com/The"),
    ("the,", BASE, "http://h.example.com/fr/the,"),
    ("?q=1", BASE, "http://h.example.com/fr/825?q=1"),
    ("../up", BASE, "http://h.example.com/up"),
    ("#frag", BASE, "http://h.example.com/fr/825?page=2"),
    ("//o.com/z", BASE, "http://o.com/z"),
    ("", BASE, ""),
    (None, None, ""),
    ("http://[bad", None, ""),
]


@pytest.mark.parametrize(("url", "base", "want"), URLS)
def test_normal_url(url, base, want):
    assert normal_url(url, base) == want


def flags(spark, fn, urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    return [r.x for r in df.select("i", fn("url").alias("x")).orderBy("i").collect()]


def test_tests_of_urls(spark):
    assert flags(spark, is_valid, ["http://a/b", "mailto:x", "/p", None]) == [True, False, False, False]
    assert flags(spark, domain, ["HTTP://U@Host:80/p", "/p"]) == ["u@host:80", ""]
    assert flags(spark, is_file, ["http://a/x.PNG?1", "http://x.js.org/", "http://a/File:x", "http://a/file"]) == [True, True, True, False]
    w = "https://ru.wikipedia.org"
    assert flags(spark, is_closed_path, [f"{w}/w/index.php", f"{w}/w/load.php?x", f"{w}/wiki/Участник:А", f"{w}/wiki/Участник%3AА", f"{w}/wiki/Q1", f"{w}/wiki/Бах", "https://en.wikipedia.org/wiki/Q1", f"{w}/wiki/Википедия:О", "http://a/w/", None]) == [True, False, True, True, True, False, False, True, False, False]
    assert flags(spark, is_article, [f"{w}/wiki/Бах", f"{w}/wiki/Категория:А", f"{w}/wiki/Категория%3AА", f"{w}/about", "http://a/wiki/Бах"]) == [True, False, False, False, False]


def test_hrefs():
    assert hrefs_of("<a href='/x?a=1&amp;b=2'>t</a><A HREF=y><a name=q><p href=z><a href>") == ["/x?a=1&b=2", "y", ""]
    assert hrefs_of(None) == [] and hrefs_of("<a href='open") == []


ODD = [
    "<a href='/x?a=1&amp;b=2'>t</a><A HREF=y><a name=q><p href=z><a href>", "<a title='a > b' href=\"x\">", "<!-- <a href=no> --><a href=yes>", "<script>'<a href=no>'</script><a href=yes>",
    "<title><a href=no></title><a href=yes>", "<title>x</title><a class=\"c\" href = 'yes'>", "<a data-href=no href=yes>", "<a href=1 href=2>", "<a\nhref=x>", "<abbr href=no><a/href=x>",
    "<a href=x", "<a href='x>y</a><a href=z>", "<a href=\"a\"b>", "<A hreF=&eacute;&#1072;>", "<a href=''>", "", None, "a < b <a href=x>", "<a href=x/>", "<a x=href>",
]


def parsed(html):
    from lyrebird.operators.crawl import _Hrefs

    reader = _Hrefs()
    reader.feed(html or "")
    reader.close()
    return reader.found


@pytest.mark.parametrize("html", ODD)
def test_pattern_and_parser_agree(html):
    assert hrefs_of(html) == parsed(html)


def test_pattern_and_parser_agree_on_pages(spark, data):
    from lyrebird.functions.url import resolved

    for r in spark.read.parquet(f"{data}/crawled.parquet").select("url", "html_content").collect():
        found = hrefs_of(r.html_content)
        assert found == parsed(r.html_content)
        assert [resolved(h, r.url) for h in found] == [normal_url(h, r.url) for h in found]


@pytest.mark.parametrize(("url", "base"), [("/x", "http://H/a/b?c#d"), ("//o/x", "http://h/"), ("http:x", "http://h/a/"), ("https://o?x", "http://h"), ("/x/../y", "http://h"), ("/x", "h"), ("/", "mailto:x"), ("/x;p?q", "http://h/a;b")])
def test_remembered_links(url, base):
    from lyrebird.functions.url import resolved

    assert resolved(url, base) == normal_url(url, base)


def page(url, *targets):
    return (url, "".join(f'<a href="{t}">t</a>' for t in targets) or "-")


GRAPH = [
    page("http://h/s", "/a", "/b", "http://other/x", "/f.png"), page("http://h/a", "/c"), page("http://h/b", "/c"),
    page("http://h/c", "/d"), page("http://h/d", "/e"), page("http://h/e", "/s"),
]


def test_breadth_first(spark):
    store = spark.createDataFrame(GRAPH, "url string, html_content string")
    start = spark.createDataFrame([("HTTP://H/s#x", "src")], "url string, source_name string")
    crawl = breadth_first(start, lambda level: store.join(level.select("url"), "url", "left_semi"), max_depth=3)
    got = {r.url[9:]: r.depth for r in crawl.collect()}
    assert got == {"s": 0, "a": 1, "b": 1, "c": 2, "d": 3}
    assert crawl_stats(crawl, store).first().failed == 0
    asked = []

    def fetch(level):
        asked.extend(r.url for r in level.collect())
        return store.join(level.select("url"), "url", "left_semi")

    assert {r.url[9:] for r in breadth_first(start, fetch, 3, max_pages=2).collect()} == {"s", "a"} and asked == ["http://h/s"]  # b isn't asked for


def test_links(spark):
    pages = spark.createDataFrame([(*GRAPH[0], 7), ("http://h/q", None, 8)], "url string, html_content string, k int")
    assert sorted((r.link, r.k) for r in links(pages, keep=["k"]).collect()) == [("http://h/a", 7), ("http://h/b", 7), ("http://other/x", 7)]


def test_upsert(spark):
    schema = "url string, html_content string, source_name string, crawl_date bigint, content_hash string"
    old = spark.createDataFrame([("u1", "a", "s", 1, "h1"), ("u2", "b", "s", 1, "h2"), ("u4", "d", "s", 1, "h4"), (None, "n", "s", 1, "n")], schema)
    new = spark.createDataFrame([("u1", "a", "t", 5, "h1"), ("u2", "x", "t", 4, "h0"), ("u2", "y", "t", 5, "h2x"), ("u3", "c", "t", 5, "h3")], schema)
    got = {r.url: (r.action, r.html_content, r.source_name, r.crawl_date) for r in upsert(old, new).collect()}
    assert got == {"u1": ("dated", "a", "s", 5), "u2": ("replaced", "y", "t", 5), "u3": ("inserted", "c", "t", 5), "u4": ("kept", "d", "s", 1)}
    again = {r.url: r.action for r in upsert(upsert(old, new), new).collect()}
    assert again == {"u1": "dated", "u2": "dated", "u3": "dated", "u4": "kept"}


def test_upsert_of_repeated_and_equal_rows(spark):
    schema = "url string, html_content string, source_name string, crawl_date bigint, content_hash string"
    old = spark.createDataFrame([("u", "a", None, None, "h")] * 3, schema)
    new = spark.createDataFrame([("u", "b", None, 4, "k"), ("u", "b", "t", 4, "k"), ("u", "b", "t", 4, "k"), ("v", None, None, None, None)], schema)
    assert sorted(map(tuple, upsert(old, new).collect())) == [("u", "b", "t", 4, "k", "replaced"), ("v", None, None, None, None, "inserted")]
    assert upsert(old.limit(0), new.limit(0)).count() == 0
    assert [tuple(r) for r in upsert(old, new.limit(0)).collect()] == [("u", "a", None, None, "h", "kept")]


def test_recheck(spark):
    now, week = 10_000_000, 7 * 86400
    df = spark.createDataFrame([(now - week,), (now - week - 1,), (None,)], "d bigint")
    assert [r.x for r in df.select(recheck_due(F.col("d"), now).alias("x")).collect()] == [False, True, True]


def test_queue_and_seeds(spark):
    now = 10_000_000
    store = spark.createDataFrame([("http://h/s", GRAPH[0][1], "src", now), ("http://h/a", "-", "src", now), ("http://h/b", "-", "src", 1)], "url string, html_content string, source_name string, crawl_date bigint")
    assert [tuple(r) for r in restored_queue(store, now).collect()] == [("http://h/b", "src", 1)]
    sources = spark.createDataFrame([("s", "http://h/s", True), ("n", "http://n/", True), ("o", "http://o/", False), (None, "http://p/", None)], "name string, url string, enabled boolean")
    assert sorted(map(tuple, seeds(sources, store, now).collect())) == [("http://n/", "n", 0), ("http://p/", "Unknown", 0)]
    assert visited(store).count() == 3


def test_robots_and_delays(spark):
    urls = spark.createDataFrame([("http://h/private/x",), ("http://h/open",), ("http://n/private/x",)], "url string")
    robots = spark.createDataFrame([("h", "User-agent: *\nDisallow: /private/")], "domain string, robots_txt string")
    assert {r.url: r.allowed for r in allowed(urls, robots).collect()} == {"http://h/private/x": False, "http://h/open": True, "http://n/private/x": True}
    assert allowed(urls, robots, respect=False).where("allowed").count() == 3
    df = spark.createDataFrame([(200, 1), (429, 1), (429, 3), (404, 1), (500, 1), (503, 3), (418, 1), (None, 1)], "s int, a int")
    assert [r.x for r in df.select(fetch_action(F.col("s"), F.col("a")).alias("x")).collect()] == ["ok", "retry", "fail", "fail", "retry", "fail", "fail", "retry"]
    assert df.select(retry_wait(F.col("s"), F.col("a")).alias("x")).collect()[2].x == 15.0
    delays = spark.createDataFrame([(1,), (9,), (None,)], "d int")
    assert [r.x for r in delays.select(crawl_delay(F.col("d")).alias("x")).collect()] == [5.0, 9.0, 5.0]


def test_copies(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("",)], "text string")
    assert sorted(r.n for r in copies(df, "text").collect()) == [1, 2]


def test_crawl_starts_from_every_stored_page(spark, tmp_path):
    from lyrebird.queries import QUERIES

    rows = [("http://h/a", "<a href=/c>c</a>", "s"), ("http://h/b", "<a href=/d>d</a>", "s"), ("http://h/d", "<a href=/e>e</a>", "s"), (None, "<a href=/f>f</a>", "s")]
    spark.createDataFrame(rows, "url string, html_content string, source_name string").write.parquet(f"{tmp_path}/crawled.parquet")
    got = {r.url[9:]: r.depth for r in QUERIES["crawl_bfs"](spark, str(tmp_path)).collect()}
    assert got == {"a": 0, "b": 0, "d": 0, "c": 1, "e": 1}
