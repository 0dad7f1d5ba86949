"""How distinctive a term is for a record (problem 4): log-entropy weights by two aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lyrebird.functions.text import extract_text, tokens
from lyrebird.plans.staging import staged


def local_frequencies(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf): the first aggregation. ``docs``: (doc_id, text); rows of null doc_id are left out.

    A row's terms are counted inside the row: they are sorted, and a term's count is the distance to the next other one.
    No text and no term crosses the network for that. What a doc_id has in several rows is added up afterwards, for those
    ids only."""
    # one projection for each step: an array that a lambda refers to must be a column, or it is made for each element
    split = docs.where("doc_id is not null").select("doc_id", F.sort_array(tokens("text")).alias("s"))
    # no filter on the array: it would be made a second time for it
    numbers = F.when(F.size("s") > 0, F.sequence(F.lit(0), F.size("s") - 1))
    starts = F.filter(numbers, lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    runs = split.select("doc_id", "s", starts.alias("a"))
    counts = F.transform("a", lambda v, k: F.struct(F.get("s", v).alias("term"), (F.coalesce(F.get("a", k + 1), F.size("s")) - v).cast("bigint").alias("tf")))
    rows = staged(runs.select("doc_id", F.inline(counts)), "tf")
    several = staged(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    added = rows.join(several, "doc_id", "left_semi").groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
    return rows.join(several, "doc_id", "left_anti").unionByName(added)


def global_weights(local: DataFrame, documents: DataFrame) -> DataFrame:
    """(term, gf, df, weight, floor): the second aggregation, one pass over the local frequencies.

    With p = tf / gf in each document, the weight is 1 + sum(p ln p) / ln N, N the number of documents: 1 for a term of
    one document, 0 for one spread evenly over all. The sum needs gf and sum(tf ln tf) only. With one document the
    weight is 1. ``floor`` is the weight of a term spread evenly over its documents, the least that as many can have."""
    sums = local.groupBy("term").agg(F.sum("tf").alias("gf"), F.count("*").alias("df"), F.sum(F.col("tf") * F.log("tf")).alias("s"))
    n = F.broadcast(documents.agg(F.count("*").alias("n")))  # a single row
    entropy = F.col("s") / F.col("gf") - F.log("gf")
    weight = F.when(F.col("n") > 1, 1 + entropy / F.log("n")).otherwise(1.0)
    floor = F.when(F.col("n") > 1, 1 - F.log("df") / F.log("n")).otherwise(1.0)
    return sums.crossJoin(n).select("term", "gf", "df", F.greatest(F.lit(0.0), weight).alias("weight"), floor.alias("floor"), "n")


def log_entropy(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf, df, weight, score, n): every term of every document with ln(1 + tf) times its global weight.

    ``docs``: (doc_id, text), one row for each document; terms of repeated rows of one doc_id add up. Null texts and texts without a token have no terms; they count
    in the number of documents. All documents and terms are scored."""
    local = local_frequencies(docs)
    # a table of its own, so that the planner can split the rows of a common term
    weights = staged(global_weights(local, docs), "weights")
    return local.join(weights, "term").select("doc_id", "term", "tf", "df", "weight", (F.log1p("tf") * F.col("weight")).alias("score"), "n")


#: Tolerance of comparisons between sums of logarithms.
EPSILON = 1e-9


def telling_words(docs: DataFrame, wanted: DataFrame, least_tf: int = 4, least_df: int = 2, most_df: int = 6, by_weight: bool = True) -> DataFrame:
    """(doc_id, term, tf, df, weight, score) of the documents in ``wanted`` (doc_id) for terms used often in them and in few
    others.

    The score decides first: a term of at most ``most_df`` of N documents, used ``least_tf`` times, weighs at least
    1 - ln(most_df) / ln N, which is that of even spread, and scores at least ln(1 + least_tf) times that. What scores lower
    is out; of the rest, which holds terms of more documents but uneven spread, the exact counts then take those outside the
    limits. Not ``by_weight``: by the counts alone, to measure what the score does."""
    scored = log_entropy(docs)
    least = 1 - F.log(F.lit(float(max(most_df, 1)))) / F.log("n")
    heavy = (F.col("n") <= 1) | ((F.col("weight") >= least - EPSILON) & (F.col("score") >= F.log1p(F.lit(float(least_tf))) * least - EPSILON))
    picked = scored.where(heavy) if by_weight else scored
    exact = picked.where((F.col("tf") >= least_tf) & F.col("df").between(least_df, most_df))
    return exact.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").drop("n")


def _pages(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/crawled.parquet")
    return pages.select(F.col("page_id").alias("doc_id"), extract_text("html_content").alias("text"))


def p4_found(spark, sf_dir: str) -> DataFrame:
    """The telling words of the pages that searches returned."""
    return telling_words(_pages(spark, sf_dir), spark.read.parquet(f"{sf_dir}/search_results.parquet")).select("doc_id", "term")


def p4_scores(spark, sf_dir: str) -> DataFrame:
    """The score of every word of every page."""
    return log_entropy(_pages(spark, sf_dir)).select("doc_id", "term", "tf", "df", F.round("score", 6).alias("score"))


def p4_telling(spark, sf_dir: str) -> DataFrame:
    """The telling words of the pages that searches returned with their scores and, within each page, their rank by score."""
    found = telling_words(_pages(spark, sf_dir), spark.read.parquet(f"{sf_dir}/search_results.parquet"))
    score = F.round("score", 6)
    return found.select("doc_id", "term", score.alias("score"), F.rank().over(Window.partitionBy("doc_id").orderBy(score.desc())).cast("bigint").alias("rank"))


_U = "'ABCDEFGHIJKLMNOPQRSTUVWXYZАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ', 'abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопрстуфхцчшщъыьэюяё'"
_TF = rf"""
with words as (select page_id as doc_id, unnest(regexp_extract_all(translate(regexp_replace(regexp_replace(regexp_replace(html_content,
    '(?is)<script.*?(?:</script[^>]*>|\z)|<style.*?(?:</style[^>]*>|\z)|<[^>]*(?:>|\z)|>', ' ', 'g'),
    '[ \t\n\x0B\f\r]+', ' ', 'g'), '^ ', ''), {_U}), '[a-z0-9а-яё]{{2,}}')) as term from crawled),
tf as (select doc_id, term, count(*) as tf from words group by all),
w as (select term, sum(tf) as gf, count(*) as df, sum(tf * ln(tf)) as s from tf group by 1),
n as (select count(*) as n from crawled)
"""
QUERIES = {"p4_found": p4_found, "p4_scores": p4_scores, "p4_telling": p4_telling}
ORACLE = {
    "p4_found": _TF + """
select doc_id, term from tf join w using (term) where tf >= 4 and df between 2 and 6
  and doc_id in (select doc_id from search_results)""",
    "p4_telling": _TF + """, scored as (select doc_id, term, round(ln(1 + tf) * greatest(0.0, 1 + (s / gf - ln(gf)) / ln(n)), 6) as score from tf join w using (term), n
  where tf >= 4 and df between 2 and 6 and doc_id in (select doc_id from search_results))
select doc_id, term, score, rank() over (partition by doc_id order by score desc) as rank from scored""",
    "p4_scores": _TF + """
select doc_id, term, tf, df, round(ln(1 + tf) * greatest(0.0, 1 + (s / gf - ln(gf)) / ln(n)), 6) as score from tf join w using (term), n""",
}
