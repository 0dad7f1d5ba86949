"""The crawl side over tables: links, gates, seeds, frontier, upsert, recheck."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lyrebird.functions.text import content_hash
from lyrebird.functions.url import domain, is_article, is_closed_path, is_file, is_valid, normalize_url, resolve_url
from lyrebird.plans.spread import spread
from lyrebird.plans.staging import staged

MIN_DELAY = 5.0


class _Hrefs(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.found += [v or "" for k, v in attrs if k == "href"][:1]


#: An <a> with its attributes, and an href among these that has a value.
_ANCHOR = re.compile(r"<a[\s/]((?:[^\"'<>]|\"[^\"<>]*\"|'[^'<>]*')*)>", re.I)
_HREF = re.compile(r"(?:^|[\s\"'/])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: What only a parser can read: comments and declarations, elements with raw text, anchors that the pattern doesn't take.
_NOT_PLAIN = re.compile(r"<[!?]|<(?:script|style|textarea|title|xmp|iframe|noembed|noframes|plaintext)\b", re.I)
_TITLE = re.compile(r"<title>[^<]*</title>", re.I)
_ANY_ANCHOR = re.compile(r"<a(?![a-zA-Z0-9])", re.I)


def hrefs_of(html: str | None) -> list[str]:
    """The href of every <a> that has one, in order, entities decoded. Broken html gives what was read so far. Pages of plain
    anchors are read by pattern, others by the parser; both give the same."""
    html = html or ""
    plain = _TITLE.sub("", html)
    if not _NOT_PLAIN.search(plain):
        anchors = _ANCHOR.findall(plain)
        if len(anchors) == len(_ANY_ANCHOR.findall(plain)):
            found = [(a, _HREF.findall(a)) for a in anchors]
            if all(len(h) == (1 if "href" in a.lower() else 0) for a, h in found):
                return [unescape(x or y or z) for _, h in found for x, y, z in h]
    reader = _Hrefs()
    try:
        reader.feed(html or "")
        reader.close()
    except (AssertionError, ValueError):
        pass
    return reader.found


@F.pandas_udf(T.ArrayType(T.StringType()))
def hrefs(html: pd.Series) -> pd.Series:
    return html.map(hrefs_of)


def links(pages: DataFrame, url: str = "url", html: str = "html_content", keep: list[str] | None = None) -> DataFrame:
    """(url, link, *keep): every link of every page in normal form against the page's URL, repeats kept; files, invalid
    URLs and pages of the encyclopedia that aren't articles are left out."""
    read = spread(pages.where(F.length(html) > 0).select(F.col(url).alias("url"), F.col(html).alias("html"), *(keep or [])))
    found = read.select("url", *(keep or []), F.explode(hrefs("html")).alias("href"))
    resolved = found.withColumn("link", resolve_url("href", "url")).drop("href")
    ok = is_valid("link") & ~is_file("link") & (~F.contains(domain("link"), F.lit("wikipedia.org")) | is_article("link"))
    return resolved.where(ok)


def recheck_due(crawl_date: Column, now: int, days: int = 7) -> Column:
    """Whether a page is due: strictly older than ``days``, or without a row or a date."""
    return F.coalesce(F.lit(now) - crawl_date > days * 86400, F.lit(True))


def visited(store: DataFrame) -> DataFrame:
    """(url, crawl_date): the distinct URLs of the store with the latest date."""
    return store.where("url is not null").groupBy("url").agg(F.max("crawl_date").alias("crawl_date"))


def _due(urls: DataFrame, seen: DataFrame, now: int, days: int) -> DataFrame:
    """The rows whose url is new or due for a recheck."""
    fresh = seen.where(~recheck_due(F.col("crawl_date"), now, days)).select("url")
    return urls.join(fresh, "url", "left_anti")


def seeds(sources: DataFrame, store: DataFrame, now: int, days: int = 7) -> DataFrame:
    """(url, source_name, depth 0) of the enabled sources that are new or due."""
    wanted = sources.where(F.coalesce(F.col("enabled"), F.lit(True))).select(normalize_url("url").alias("url"), F.coalesce("name", F.lit("Unknown")).alias("source_name"), F.lit(0).alias("depth"))
    return _due(wanted, visited(store), now, days)


def restored_queue(store: DataFrame, now: int, days: int = 7, source: str | None = None) -> DataFrame:
    """(url, source_name, depth 1): links of stored pages to the same host that are new or due, each once; of equal
    links the source name that sorts first."""
    read = store if source is None else store.where(F.col("source_name") == source)
    found = links(read, keep=["source_name"]).where((domain("link") == domain("url")) & ~is_closed_path("link"))
    once = found.groupBy("link").agg(F.min(F.coalesce("source_name", F.lit("Unknown"))).alias("source_name"))
    return _due(once.select(F.col("link").alias("url"), "source_name", F.lit(1).alias("depth")), visited(store), now, days)


PAGE = ("html_content", "source_name", "crawl_date", "content_hash")


def _ahead(rows: DataFrame) -> DataFrame:
    """The rows of a url with what settles which of them counts: the latest date, then the larger hash, then, should that not
    be of the content, the content's own, then the source name that sorts last."""
    own = F.xxhash64("html_content").alias("own")
    return rows.where("url is not null").select("url", F.struct("crawl_date", "content_hash", own, "source_name").alias("ahead"), *PAGE)


def _winners(rows: DataFrame) -> DataFrame:
    """(url, ahead, n): each url's row that counts, without its content, and how many equal ones there are."""
    counted = rows.groupBy("url", "ahead").agg(F.count("*").alias("n"))
    return counted.groupBy("url").agg(F.max(F.struct("ahead", "n")).alias("w")).select("url", "w.ahead", "w.n")


def upsert(store: DataFrame, crawl: DataFrame) -> DataFrame:
    """The store after a crawl, with what happened to each URL: inserted, replaced, dated (unchanged content, new date
    only) or kept. Both sides: url, html_content, source_name, crawl_date, content_hash. Of several fetches of a URL the
    latest counts, then the larger hash; of several stored rows too. Rows of null url are left out.

    What happens is settled on narrow rows (url, date, hash). Only the rows that end up in the store are then looked up with
    their content, once; they are grouped only where equal rows repeat."""
    old, new = _ahead(store), _ahead(crawl)
    before = _winners(old).select("url", F.col("ahead").alias("o"), F.col("n").alias("on"))
    after = _winners(new).select("url", F.col("ahead").alias("f"), F.col("n").alias("fn"))
    same = F.coalesce(F.col("o.content_hash") == F.col("f.content_hash"), F.lit(False))
    action = F.when(F.col("f").isNull(), "kept").when(F.col("o").isNull(), "inserted").when(same, "dated").otherwise("replaced")
    date = F.when(F.col("f").isNull(), F.col("o.crawl_date")).otherwise(F.col("f.crawl_date"))
    settled = staged(before.join(after, "url", "full_outer").select("url", action.alias("action"), date.alias("date"), "o", "on", "f", "fn"), "settled")

    def taken(rows: DataFrame, own: str, n: str, actions: list[str]) -> DataFrame:
        wanted = settled.where(F.col("action").isin(actions)).select("url", F.col(own).alias("ahead"), F.col(n).alias("n"), "action", "date")
        found = rows.join(wanted, ["url", "ahead"])
        several = found.where("n > 1").dropDuplicates(["url"])
        both = found.where("n = 1").unionByName(several)
        return both.select("url", "html_content", "source_name", F.col("date").alias("crawl_date"), "content_hash", "action")

    return taken(old, "o", "on", ["kept", "dated"]).unionByName(taken(new, "f", "fn", ["inserted", "replaced"]))


def fetch_action(status: Column, attempt: Column, tries: int = 3) -> Column:
    """What follows a response: ok, retry or fail. 200 is fine; 429, server errors and no response (null) are tried
    again up to ``tries`` times; 403, 404 and other client errors fail at once."""
    again = F.when(attempt < tries, "retry").otherwise("fail")
    return F.when(status.isNull(), again).when(status == 200, "ok").when((status == 429) | (status >= 500), again).when(status < 400, "ok").otherwise("fail")


def retry_wait(status: Column, attempt: Column) -> Column:
    """Seconds before the next try: 5 times the number of the attempt after 429, else at least 5."""
    return F.when(status == 429, attempt * 5).otherwise(F.greatest(F.lit(MIN_DELAY), attempt * 2)).cast("double")


def crawl_delay(robots: Column, configured: float = MIN_DELAY) -> Column:
    """Seconds between requests to a host: what robots.txt asks for, else the configured delay; never below 5."""
    return F.greatest(F.coalesce(robots.cast("double"), F.lit(float(configured))), F.lit(MIN_DELAY))


def allowed(urls: DataFrame, robots: DataFrame, agent: str = "*", respect: bool = True) -> DataFrame:
    """The rows with ``allowed``: articles may always be fetched, closed paths never; other pages by their host's
    robots.txt, if it is respected and there is one. ``robots``: (domain, robots_txt), one row for each host."""
    rows = urls.withColumn("_domain", domain("url"))
    closed, article = is_closed_path("url"), is_article("url")
    if not respect:
        return rows.withColumn("allowed", article | ~closed).drop("_domain")

    def gate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsers: dict[str, RobotFileParser] = {}
        for frame in frames:
            out = []
            for url, rules in zip(frame["url"], frame["robots_txt"]):
                parser = parsers.get(rules)
                if parser is None:
                    parser = parsers[rules] = RobotFileParser()
                    parser.parse(rules.splitlines())
                out.append(parser.can_fetch(agent, url))
            yield pd.DataFrame({"url": frame["url"], "may": out})

    # rules are held against the distinct URLs that they can decide; articles and closed paths need none, nor do hosts without
    ruled = robots.where("robots_txt is not null").select(F.col("domain").alias("_domain"), "robots_txt")
    asked = rows.where(~article & ~closed & F.col("url").isNotNull()).select("url", "_domain").distinct().join(ruled, "_domain")
    barred = staged(asked.select("url", "robots_txt").mapInPandas(gate, "url string, may boolean").where("not may").select("url", F.lit(True).alias("_barred")), "barred")
    joined = rows.join(barred, "url", "left")
    return joined.withColumn("allowed", article | (~closed & F.col("_barred").isNull())).select(*urls.columns, "allowed")


def breadth_first(start: DataFrame, fetch: Callable[[DataFrame], DataFrame], max_depth: int = 3, max_pages: int = 0) -> DataFrame:
    """(url, source_name, depth): the pages of a crawl that follows links to the same host level by level.

    ``start``: (url, source_name); ``fetch`` turns (url, source_name, depth) into (url, html_content) of the pages it
    gets. A page's links are followed only while its depth is below ``max_depth``; each URL is fetched once, whether or
    not that worked. ``max_pages`` ends the crawl after that many pages (0: no end), lower URLs of a level first: those
    beyond aren't fetched. Each level is kept as a table, so that the plan stays flat; the number of levels is bounded by
    ``max_depth``."""

    def cut(level: DataFrame, room: int) -> DataFrame:
        return level.orderBy("url").limit(room) if max_pages else level

    first = start.select(normalize_url("url").alias("url"), "source_name", F.lit(0).alias("depth")).groupBy("url", "depth").agg(F.min("source_name").alias("source_name"))
    level = staged(cut(first, max_pages), "level")
    seen, done, left = level.select("url"), level, max_pages
    for depth in range(max_depth):
        left -= level.count() if max_pages else 0
        if max_pages and left <= 0:
            break
        pages = fetch(level)
        found = links(pages).where((domain("link") == domain("url")) & ~is_closed_path("link"))
        next_ = found.join(level.select("url", "source_name"), "url").groupBy("link").agg(F.min("source_name").alias("source_name"))
        fresh = next_.select(F.col("link").alias("url"), F.lit(depth + 1).alias("depth"), "source_name").join(seen, "url", "left_anti")
        level = staged(cut(fresh, left), "level")
        if level.isEmpty():
            break
        seen = staged(seen.unionByName(level.select("url")), "seen")
        done = done.unionByName(level)
    return done.select("url", "source_name", "depth")


def crawl_stats(pages: DataFrame, fetched: DataFrame) -> DataFrame:
    """One row: pages asked for, saved (failures count as visited) and failed."""
    got = pages.join(fetched.select("url").distinct().withColumn("_ok", F.lit(1)), "url", "left")
    return got.agg(F.count("*").alias("crawled"), F.count("*").alias("saved"), F.count(F.when(F.col("_ok").isNull(), 1)).alias("failed"))


def with_hash(pages: DataFrame) -> DataFrame:
    """The pages with the hash of their html as it is."""
    return pages.withColumn("content_hash", content_hash("html_content"))


def copies(rows: DataFrame, text: str) -> DataFrame:
    """(hash, n): how many rows hold each content. Null texts are left out."""
    return rows.where(F.col(text).isNotNull()).groupBy(content_hash(text).alias("hash")).agg(F.count("*").alias("n"))


