"""A crawl from its settings to the store: seeds, restored queue, gates, fetching by host, upsert, and the next wave."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.functions.text import content_hash
from lyrebird.functions.url import domain, is_closed_path
from lyrebird.operators.crawl import MIN_DELAY, allowed, links, recheck_due, restored_queue, seeds, visited
from lyrebird.plans.staging import staged
from lyrebird.sources.fetch import fetch_pages, fetch_robots, http_get
from lyrebird.streaming.ingest import Store

QUEUE = ["url", "source_name", "depth"]


def crawl(
    spark: SparkSession,
    logic: dict,
    store: Store,
    get: Callable[[str], tuple[int | None, str | None]] = http_get,
    agent: str = "*",
    now: int | None = None,
    sleep: Callable[[float], None] = time.sleep,
    clock: Callable[[], float] = time.monotonic,
    report: Callable[[str], None] | None = None,
) -> dict[str, int]:
    """Crawls as the settings say (``load_config``) and stores what it gets; how many pages were asked for, stored, failed
    and barred, and how many were left when ``max_pages`` ended it.

    The queue is worked off in waves: the enabled sources that are new or due and, if pages are stored already, their links
    that are; then the links to the same host of each wave's pages, as long as these lie above ``max_depth``. A page is asked
    for once in a crawl, whether or not that works. Closed paths and what a host's robots.txt bars aren't fetched; the file is
    read once for each host, and its delay holds if it is longer than the configured one. ``max_pages`` (0: no end) is a limit
    on pages asked for: of a wave that goes beyond it, the rest isn't fetched, lower depths and then lower URLs first. Every
    wave is one batch of the store, so that a crawl that is stopped goes on from what it has stored.
    """
    now = int(time.time()) if now is None else now
    days, most, deepest = int(logic["recheck_interval_days"]), int(logic["max_pages"]), int(logic["max_depth"])
    tell = report or (lambda text: None)
    listed = [(s.get("name"), s.get("url"), s.get("enabled", True)) for s in logic["sources"]]
    sources = spark.createDataFrame(listed, "name string, url string, enabled boolean")
    had = staged(store.current().drop("action"), "stored")
    queue = seeds(sources, had, now, days).select(*QUEUE)
    if logic.get("restore_queue_from_saved", True):
        names = sources.where(F.coalesce("enabled", F.lit(True))).select(F.coalesce("name", F.lit("Unknown")).alias("source_name")).distinct()
        queue = queue.unionByName(restored_queue(had.join(names, "source_name", "left_semi"), now, days).select(*QUEUE))
    fresh = visited(had).where(~recheck_due(F.col("crawl_date"), now, days)).select("url")
    wave = _once(queue.where("url <> ''"))
    seen = spark.createDataFrame([], "url string")
    robots = spark.createDataFrame([], "domain string, robots_txt string, delay double")
    counts = {"asked": 0, "stored": 0, "failed": 0, "barred": 0, "left": 0}
    number = _next_number(store)
    while not wave.isEmpty():
        hosts = wave.select(F.regexp_extract("url", "^([^:]+):", 1).alias("scheme"), domain("url").alias("domain")).distinct().join(robots, "domain", "left_anti")
        if logic.get("respect_robots_txt", True):
            robots = staged(robots.unionByName(fetch_robots(hosts, get, agent)), "robots")
        gated = staged(allowed(wave, robots.select("domain", "robots_txt"), agent, bool(logic.get("respect_robots_txt", True))), "gated")
        wanted = gated.where("allowed").select(*QUEUE)
        total = wanted.count()
        counts["barred"] += gated.where("not allowed").count()
        if most:
            room = most - counts["asked"]
            wanted = wanted.orderBy("depth", "url").limit(room)
            counts["left"], total = max(0, total - room), min(total, room)
        paced = wanted.withColumn("domain", domain("url")).join(robots.select("domain", "delay"), "domain", "left").drop("domain")
        got = staged(fetch_pages(paced, get, delay=float(logic.get("delay_between_requests", MIN_DELAY)), sleep=sleep, clock=clock), "fetched")
        pages = got.where("html_content is not null").withColumn("content_hash", content_hash("html_content"))
        store.apply(pages.select("url", "html_content", "source_name", "crawl_date", "content_hash"), number)
        number += 1
        stored = pages.count()
        counts["asked"] += total
        counts["stored"] += stored
        counts["failed"] += total - stored
        tell(f"asked {counts['asked']}, stored {counts['stored']}, failed {counts['failed']}, barred {counts['barred']}")
        if most and counts["asked"] >= most:
            break
        seen = staged(seen.unionByName(gated.select("url")), "seen")
        found = links(pages.where(F.col("depth") < deepest), keep=["source_name", "depth"]).where((domain("link") == domain("url")) & ~is_closed_path("link"))
        new = found.select(F.col("link").alias("url"), "source_name", (F.col("depth") + 1).alias("depth"))
        wave = _once(new.join(seen, "url", "left_anti").join(fresh, "url", "left_anti"))
    return counts


def _once(queue: DataFrame) -> DataFrame:
    """Each URL once: at its least depth, and of the source names there the one that sorts first."""
    return staged(queue.groupBy("url").agg(F.min(F.struct("depth", "source_name")).alias("m")).select("url", "m.source_name", "m.depth"), "wave")


def _next_number(store: Store) -> int:
    pointer = store._pointer()
    return 0 if pointer is None else pointer["batch"] + 1
