"""Command line: crawl, build an index, search it, serve it, or print the statistics of a corpus."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

#: Pages that ``stats --test`` reads; top terms on the screen and in the file.
TEST_PAGES, TOP_SHOWN, TOP_WRITTEN = 10, 20, 100


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lyrebird")
    commands = parser.add_subparsers(dest="command", required=True)
    crawl = commands.add_parser("crawl", help="crawl as a settings file says, into a store of pages")
    crawl.add_argument("config")
    crawl.add_argument("store")
    crawl.add_argument("--agent", default="lyrebird")
    build = commands.add_parser("index", help="build an index of stored pages")
    build.add_argument("pages")
    build.add_argument("output")
    build.add_argument("--key", default="url")
    build.add_argument("--limit", type=int)
    find = commands.add_parser("search", help="search an index; without -q one query for each line of the input")
    find.add_argument("index")
    find.add_argument("-q", "--query")
    find.add_argument("-i", "--interactive", action="store_true", help="ask for queries until the input ends")
    find.add_argument("-l", "--limit", type=int, default=10)
    find.add_argument("--stats", action="store_true")
    web = commands.add_parser("serve", help="serve an index over HTTP")
    web.add_argument("index")
    web.add_argument("--host", default="127.0.0.1")
    web.add_argument("--port", type=int, default=8080)
    stats = commands.add_parser("stats", help="statistics, top tokens and stems, and the fit of a corpus")
    stats.add_argument("pages")
    stats.add_argument("--limit", type=int)
    stats.add_argument("--test", action="store_true", help=f"read {TEST_PAGES} pages only")
    stats.add_argument("--top", type=int, default=TOP_SHOWN)
    stats.add_argument("--output", help="a folder for the statistics, the rank table and the plot script")
    return parser


def _crawl(spark: SparkSession, a: argparse.Namespace) -> None:
    from lyrebird.operators.waves import crawl
    from lyrebird.sources.index_store import load_config
    from lyrebird.streaming.ingest import Store

    began = time.perf_counter()
    counts = crawl(spark, load_config(a.config)["logic"], Store(spark, a.store), agent=a.agent, report=print)
    seconds = time.perf_counter() - began
    print(", ".join(f"{k} {v}" for k, v in counts.items()), f"in {seconds:.1f} s")


def _search(spark: SparkSession, a: argparse.Namespace) -> None:
    from lyrebird.operators.search import search
    from lyrebird.sources.index_store import open_index

    index = open_index(spark, a.index)
    if a.stats:
        index.stats.show(truncate=False)

    def lines():
        while True:
            if a.interactive:
                print(">>> ", end="", flush=True)
            line = sys.stdin.readline()
            if not line:
                return
            if line.strip():
                yield line.strip()

    for query in [a.query] if a.query else lines():
        r = search(index, query, a.limit)
        print(f"{query}: {r.total_count} ({r.query_time_ms:.1f} ms)")
        if not r.total_count:
            print("  nothing found: is the term in the index? --stats shows its size")
        for row in r.results:
            print(f"  [{row['doc_id']}] {row['title']}  {row['url']}")


def _stats(spark: SparkSession, a: argparse.Namespace) -> None:
    from lyrebird.operators import corpus
    from lyrebird.operators.index import per_second
    from lyrebird.plans.staging import staged
    from lyrebird.sources.reports import plot_script, write_rank_table, write_statistics

    limit = TEST_PAGES if a.test else a.limit
    pages = spark.read.parquet(a.pages)
    pages = pages if limit is None else pages.limit(limit)
    began = time.perf_counter()
    freq = staged(corpus.token_frequencies(pages), "freq")
    stems = staged(corpus.stem_frequencies(freq), "stems")
    figures = staged(corpus.corpus_stats(pages), "stats")
    row = figures.first()
    seconds = time.perf_counter() - began
    figures.show(truncate=False)
    print(f"{seconds:.2f} s, {per_second(row['total_tokens'], seconds):.0f} tokens/s, {per_second(row['total_bytes'] / 1024, seconds):.2f} KB/s")
    corpus.top(freq, a.top).show(a.top, truncate=False)
    corpus.top(stems, a.top, "stem").show(a.top, truncate=False)
    ranks = staged(corpus.ranked(corpus.token_frequencies(pages, stop_words=None, numbers=True)), "ranks")
    fit = corpus.mandelbrot_fit(ranks)
    fit.show()
    if a.output:
        folder = Path(a.output)
        folder.mkdir(parents=True, exist_ok=True)
        write_statistics(figures, corpus.top(freq, TOP_WRITTEN), str(folder / "statistics.txt"), seconds)
        write_rank_table(ranks, (folder / "ranks").as_uri())
        if (best := fit.first()) is not None:
            script = plot_script("ranks/*.txt", "ranks.png", "ranks", int(row["total_tokens"]), best["b"], best["rho"], best["p"])
            (folder / "ranks.gp").write_text(script, encoding="utf-8")


def main(args: list[str] | None = None) -> int:
    a = _arguments().parse_args(args)
    spark = SparkSession.builder.appName("lyrebird").getOrCreate()
    if a.command == "crawl":
        _crawl(spark, a)
    elif a.command == "index":
        from lyrebird.operators.index import build
        from lyrebird.sources.index_store import write_index

        index = build(spark.read.parquet(a.pages), a.key, limit=a.limit, progress=print)
        write_index(index, a.output)
        index.stats.show(truncate=False)
    elif a.command == "search":
        _search(spark, a)
    elif a.command == "serve":
        from lyrebird.sources.index_store import open_index
        from lyrebird.sources.server import serve

        serve(open_index(spark, a.index), a.host, a.port).serve_forever()
    else:
        _stats(spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
