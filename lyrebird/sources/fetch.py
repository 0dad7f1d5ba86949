"""Fetching pages as a table operation: robots, delays and retries by host."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import quote, urlsplit, urlunsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.functions.url import domain
from lyrebird.operators.crawl import MIN_DELAY

SCHEMA = "url string, source_name string, depth int, status int, html_content string, crawl_date bigint"


def ascii_url(url: str) -> str:
    """The URL with its path percent-encoded, if it holds other characters than ASCII."""
    parts = urlsplit(url)
    return url if parts.path.isascii() else urlunsplit(parts._replace(path=quote(parts.path, safe="/%")))


def http_get(url: str, timeout: float = 30.0, agent: str = "lyrebird") -> tuple[int | None, str | None]:
    """Status and text of a page; no status if there was no response."""
    try:
        with urllib.request.urlopen(urllib.request.Request(ascii_url(url), headers={"User-Agent": agent}), timeout=timeout) as r:
            return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, None
    except (OSError, ValueError):
        return None, None


def outcome(status: int | None, attempt: int, tries: int) -> str:
    """The same table of outcomes as ``fetch_action``, for one response."""
    if status == 200:
        return "ok"
    if status is None or status == 429 or status >= 500:
        return "retry" if attempt < tries else "fail"
    return "ok" if status < 400 else "fail"


def fetch_pages(
    wanted: DataFrame,
    get: Callable[[str], tuple[int | None, str | None]] = http_get,
    delays: dict[str, float] | None = None,
    delay: float = MIN_DELAY,
    tries: int = 3,
    hosts_at_once: int = 64,
    sleep: Callable[[float], None] = time.sleep,
    clock: Callable[[], float] = time.monotonic,
) -> DataFrame:
    """(url, source_name, depth, status, html_content, crawl_date) of the wanted pages (url, source_name, depth), with
    null html where fetching failed.

    Pages are dealt by host, so that one task alone talks to a host; the dealing is kept as it is (``hosts_at_once`` tasks).
    A task knows when it last asked each of its hosts, over all of its batches, and waits only for what is left of that
    host's delay; a retry waits for that too, and for its own time. ``delays``: seconds by host, or a column ``delay`` of the
    wanted pages; never below 5."""
    slow, usual = {h: max(s, MIN_DELAY) for h, s in (delays or {}).items()}, max(delay, MIN_DELAY)
    own_delay = F.col("delay").cast("double") if "delay" in wanted.columns else F.lit(None).cast("double")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}

        def wait(host: str, seconds: float) -> None:
            if host in last and (rest := last[host] + seconds - clock()) > 0:
                sleep(rest)
            last[host] = clock()

        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                each = slow.get(r.host, usual if pd.isna(r.own_delay) else max(float(r.own_delay), MIN_DELAY))
                pause = each
                for attempt in range(1, tries + 1):
                    wait(r.host, pause)
                    status, text = get(r.url)
                    what = outcome(status, attempt, tries)
                    if what != "retry":
                        break
                    pause = max(each, 5.0 * attempt if status == 429 else max(MIN_DELAY, 2.0 * attempt))
                rows.append((r.url, r.source_name, r.depth, status, text if what == "ok" else None, int(time.time())))
            out = pd.DataFrame(rows, columns=["url", "source_name", "depth", "status", "html_content", "crawl_date"])
            yield out.astype({"status": "Int32"})

    dealt = wanted.select("url", "source_name", "depth", domain("url").alias("host"), own_delay.alias("own_delay")).repartition(hosts_at_once, F.col("host"))
    return dealt.sortWithinPartitions("host", "url").mapInPandas(run, SCHEMA)


def fetch_robots(hosts: DataFrame, get: Callable[[str], tuple[int | None, str | None]] = http_get, agent: str = "*", hosts_at_once: int = 64) -> DataFrame:
    """(domain, robots_txt, delay) for each of the hosts (scheme, domain): the text, null if there is none, and the seconds it
    asks for between requests, null if it names none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                status, text = get(f"{r.scheme}://{r.domain}/robots.txt")
                text = text if status == 200 else None
                rows.append((r.domain, text, robots_delay(text, agent)))
            yield pd.DataFrame(rows, columns=["domain", "robots_txt", "delay"]).astype({"delay": "Float64"})

    once = hosts.groupBy("domain").agg(F.min("scheme").alias("scheme")).select("scheme", "domain")
    return once.repartition(hosts_at_once, F.col("domain")).mapInPandas(run, "domain string, robots_txt string, delay double")


def robots_delay(text: str | None, agent: str = "*") -> float | None:
    """The seconds that a robots.txt asks ``agent`` to wait; None if it doesn't say."""
    if not text:
        return None
    parser = RobotFileParser()
    parser.parse(text.splitlines())
    found = parser.crawl_delay(agent)
    return None if found is None else float(found)
