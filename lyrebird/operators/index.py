"""The inverted index as DataFrames: documents, postings, statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyrebird.functions.text import extract_text, extract_title, tokens
from lyrebird.plans.spread import spread
from lyrebird.plans.staging import staged


def dense_ids(df: DataFrame, key: str, name: str = "doc_id") -> DataFrame:
    """The rows with a number from 0 without gaps in the order of ``key`` (and all other columns, for equal keys).

    Rows are ranged into buckets, kept as a table, numbered inside each bucket, and shifted by the sizes of the buckets
    before; only the sizes, one row for each bucket, meet in one task."""
    ranged = staged(df.repartitionByRange(F.col(key)).withColumn("_bucket", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    rest = [F.col(c) for c in df.columns if c != key and df.schema[c].dataType.typeName() not in ("map", "array", "struct")]
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.col(key), *rest)) - 1
    numbered = ranged.withColumn("_own", own).join(F.broadcast(before), "_bucket")  # a row for each bucket
    return numbered.withColumn(name, (F.col("_before") + F.col("_own")).cast("bigint")).drop("_bucket", "_own", "_before")


@dataclass
class Index:
    """``docs``: doc_id, title, url, key. ``postings``: term, doc_id, distinct. ``stats``: one row."""

    docs: DataFrame
    postings: DataFrame
    stats: DataFrame

    def inverted(self) -> DataFrame:
        """(term, df, postings): every term with its ascending posting list, whole. For corpora in which a term's list
        doesn't fit a row, ``blocks`` gives the same in pieces."""
        return self.postings.groupBy("term").agg(F.count("*").alias("df"), F.sort_array(F.collect_list("doc_id")).alias("postings"))

    def blocks(self, size: int = 65_536) -> DataFrame:
        """(term, block, df, postings): the lists in blocks of ``size`` document ids, so that no row grows with the corpus
        and a common term is spread over many tasks. ``df`` counts the block."""
        block = F.floor(F.col("doc_id") / F.lit(size)).alias("block")
        return self.postings.groupBy("term", block).agg(F.count("*").alias("df"), F.sort_array(F.collect_list("doc_id")).alias("postings"))


def page_texts(pages: DataFrame, key: str = "page_id", html: str = "html_content", url: str = "url", limit: int | None = None) -> DataFrame:
    """(doc_id, key, title, url, text, toks) of each page with html, by ascending key. ``limit`` counts pages before empty
    ones are left out. Null urls become ''.

    The pages are extracted once, into a table. The ids are given to narrow rows of it (the key, a hash of the rest and the
    row's number), so that no text is sorted or moved to be counted, and then joined back by the row's number."""
    read = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    if limit is not None:
        read = read.orderBy("key").limit(limit)
    dealt = spread(read.where("html <> ''"))
    text = dealt.select("key", "url", extract_title("html").alias("title"), extract_text("html").alias("text"))
    extracted = staged(text.withColumn("toks", tokens("text")).withColumn("row", F.monotonically_increasing_id()), "extracted")
    ids = dense_ids(extracted.select("key", F.xxhash64("url", "title", "text").alias("rest"), "row"), "key").select("row", "doc_id")
    return extracted.join(staged(ids, "ids").hint("shuffle_hash"), "row").select("doc_id", "key", "title", "url", "text", "toks")


def build(
    pages: DataFrame,
    key: str = "page_id",
    html: str = "html_content",
    url: str = "url",
    limit: int | None = None,
    progress: Callable[[str], None] | None = None,
) -> Index:
    """The index of a corpus. The tokenised pages are kept as one table that documents and statistics read; the postings as
    another, ranged and sorted by term, so that a search reads only the parts of its files that its terms lie in.
    ``progress`` is told what is done."""
    tell = progress or (lambda what: None)
    texts = staged(page_texts(pages, key, html, url, limit), "texts")
    tell("pages tokenised")
    docs = texts.select("doc_id", "title", "url", "key")
    pairs = texts.select(F.explode(F.array_distinct("toks")).alias("term"), "doc_id")
    postings = staged(pairs.repartitionByRange("term"), "postings", by=["term", "doc_id"])
    tell("postings sorted")
    return Index(docs, postings, index_stats(texts, postings))


def index_stats(texts: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: documents, tokens, distinct terms, postings, bytes of text, mean length of a term in bytes."""
    per_doc = texts.agg(
        F.count("*").alias("total_documents"),
        F.coalesce(F.sum(F.size("toks")), F.lit(0)).cast("bigint").alias("total_tokens"),
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("bigint").alias("total_text_bytes"),
    )
    per_term = postings.groupBy("term").agg(F.count("*").alias("df")).agg(
        F.count("*").alias("unique_terms"),
        F.coalesce(F.sum("df"), F.lit(0)).cast("bigint").alias("total_postings"),
        F.round(F.coalesce(F.avg(F.octet_length("term")), F.lit(0.0)), 6).alias("avg_term_length"),
    )
    return per_doc.crossJoin(per_term)  # one row by one row


def per_second(amount: float, seconds: float) -> float:
    """A rate; 0 where no time passed."""
    return amount / seconds if seconds > 0 else 0.0


def document_count(pages: DataFrame, limit: int | None = None) -> Column | int:
    """The number of stored pages, at most ``limit``."""
    n = pages.count()
    return n if limit is None else min(n, limit)
