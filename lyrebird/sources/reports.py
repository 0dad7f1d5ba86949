"""Small text outputs: rank tables, plot scripts, statistics, result pages."""

from __future__ import annotations

from html import escape
from pathlib import Path
from urllib.parse import quote_plus

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_rank_table(ranks: DataFrame, path: str) -> None:
    """rank, frequency and term by tabs, with a heading, in files ordered by rank."""
    lines = ranks.select("rank", F.concat_ws("\t", "rank", "cnt", "term").alias("value"))
    head = ranks.sparkSession.createDataFrame([(0, "# Rank\tFrequency\tTerm")], "rank bigint, value string")
    ordered = head.unionByName(lines).repartitionByRange("rank").sortWithinPartitions("rank")
    ordered.select("value").write.mode("overwrite").text(path)


def plot_script(data: str, image: str, title: str, total: int, b: float, rho: float, p: float) -> str:
    """A gnuplot script of the ranks against Zipf's and Mandelbrot's law on logarithmic axes."""
    curves = [
        f"'{data}' using 1:2 with points pt 7 ps 0.3 title 'counts'",
        "zipf(x) with lines lw 2 title 'Zipf'",
        "mandelbrot(x) with lines lw 2 title 'Mandelbrot'",
    ]
    return "\n".join(
        [
            "set terminal png size 1200,800",
            f"set output '{image}'",
            f"set title '{title}'",
            "set logscale xy",
            "set grid",
            f"zipf(x) = {total} / (1.78 * x)",
            f"mandelbrot(x) = {p!r} / (x + {rho!r})**{b!r}",
            "plot " + ", ".join(curves),
            "",
        ]
    )


def write_statistics(stats: DataFrame, top: DataFrame, path: str, seconds: float | None = None) -> None:
    """The one row of statistics, the speed if the time is given, and the top tokens (a bounded table) as text."""
    row = stats.first().asDict()
    lines = [f"{k}: {v}" for k, v in row.items()]
    if seconds:
        lines += [f"seconds: {seconds:.2f}", f"tokens a second: {row['total_tokens'] / seconds:.0f}", f"KB a second: {row['total_bytes'] / 1024 / seconds:.2f}"]
    lines += ["", "top tokens:"]
    lines += [f"{r['rank']}. {r['token']}: {r['cnt']}" for r in top.orderBy("rank").collect()]
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")


#: What the start page says about queries.
SYNTAX = (("one two", "both words"), ("one && two", "both words"), ("one || two", "one of them, or both"), ("!one", "pages without the word"), ("(one || two) && !three", "brackets group"))


def _form(query: str) -> str:
    return f'<form action="/search"><input type="text" name="q" value="{escape(query)}"><button type="submit">Search</button></form>'


def start_page() -> str:
    """The page with the form and what a query may look like."""
    rows = "".join(f"<tr><td><code>{escape(q)}</code></td><td>{escape(text)}</td></tr>" for q, text in SYNTAX)
    return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>Search</title></head><body>{_form('')}<table>{rows}</table></body></html>"


def result_page(query: str, total: int, rows: list, page: int, pages: int, ms: float = 0.0) -> str:
    """A page of results as HTML, with links to the pages before and after."""
    items = "".join(f'<li><a href="{escape(r["url"] or "")}">{escape(r["title"] or "")}</a> <cite>{escape(r["url"] or "")}</cite></li>' for r in rows)
    body = f"<ol>{items}</ol>" if rows else f"<p>Nothing found for <b>{escape(query)}</b></p>"
    to = lambda n, text: f'<a href="/search?q={quote_plus(query)}&amp;page={n}">{text}</a> '
    links = (to(page - 1, "Previous") if page > 1 else "") + f"Page {page} of {pages} " + (to(page + 1, "Next") if page < pages else "")
    head = f'<head><meta charset="utf-8"><title>{escape(query)}</title></head>'
    return f"<!DOCTYPE html><html>{head}<body>{_form(query)}<p>{total} documents in {ms:.2f} ms</p>{body}<p>{links}</p></body></html>"
