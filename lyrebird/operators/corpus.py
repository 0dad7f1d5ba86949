"""Corpus statistics: token and stem frequencies, ranks, and the laws fitted to them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lyrebird.functions.stem import stemmed
from lyrebird.functions.text import STOP_WORDS, extract_text, tokens, without_numbers
from lyrebird.operators.index import dense_ids
from lyrebird.plans.spread import spread
from lyrebird.plans.staging import staged


def token_frequencies(pages: DataFrame, html: str = "html_content", stop_words: list[str] | None = STOP_WORDS, numbers: bool = False, min_length: int = 2) -> DataFrame:
    """(token, cnt) over all pages; without stop words and, unless ``numbers``, without tokens of digits alone."""
    found = tokens(extract_text(html), min_length, stopwords=stop_words)
    found = found if numbers else without_numbers(found)
    return spread(pages.where(F.length(html) > 0).select(html)).select(F.explode(found).alias("token")).groupBy("token").agg(F.count("*").alias("cnt"))


def stem_frequencies(frequencies: DataFrame) -> DataFrame:
    """(stem, cnt): distinct tokens are stemmed once each, then added up."""
    return stemmed(frequencies, "token", "stem").groupBy("stem").agg(F.sum("cnt").alias("cnt"))


def corpus_stats(pages: DataFrame, html: str = "html_content") -> DataFrame:
    """One row: all documents (empty ones too), bytes of html, tokens, distinct tokens and stems, mean token length in
    characters over all tokens."""
    freq = staged(token_frequencies(pages, html), "freq")
    docs = pages.agg(F.count("*").alias("total_documents"), F.coalesce(F.sum(F.octet_length(html)), F.lit(0)).cast("bigint").alias("total_bytes"))
    words = freq.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint").alias("total_tokens"),
        F.count("*").alias("unique_tokens"),
        F.round(F.coalesce(F.sum(F.col("cnt") * F.char_length("token")) / F.sum("cnt"), F.lit(0.0)), 6).alias("avg_token_length"),
    )
    stems = stem_frequencies(freq).agg(F.count("*").alias("unique_stems"))
    return docs.crossJoin(words).crossJoin(stems)  # single rows


def top(frequencies: DataFrame, k: int, term: str = "token") -> DataFrame:
    """(rank, term, cnt) of the ``k`` most frequent, ties by the term; the ranks are given to ``k`` rows only."""
    best = frequencies.orderBy(F.desc("cnt"), F.asc(term)).limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("cnt"), F.asc(term))).cast("bigint").alias("rank"), term, "cnt")


def ranked(frequencies: DataFrame, term: str = "token") -> DataFrame:
    """(rank, cnt, term) of all terms by falling frequency, ties by the term, from 1.

    The terms are ranged and numbered in buckets, so that no task sorts them all."""
    keyed = frequencies.select(F.struct((-F.col("cnt")).alias("neg"), F.col(term).alias("term")).alias("_key"), F.col("cnt"), F.col(term).alias("term"))
    numbered = dense_ids(keyed, "_key", "_id")
    return numbered.select((F.col("_id") + 1).alias("rank"), "cnt", "term")


def _total(ranks: DataFrame) -> DataFrame:
    return F.broadcast(ranks.agg(F.sum("cnt").cast("double").alias("_all")))  # a single row


def zipf(ranks: DataFrame, s: float = 1.0) -> DataFrame:
    """(rank, cnt, theoretical): C / rank^s, C such that the sum over all ranks is that of the counts."""
    power = ranks.withColumn("_p", F.pow(F.col("rank").cast("double"), F.lit(-float(s))))
    norm = F.broadcast(power.agg(F.sum("_p").alias("_norm"), F.sum("cnt").cast("double").alias("_all")))  # a single row
    return power.crossJoin(norm).select("rank", "cnt", (F.col("_all") / F.col("_norm") * F.col("_p")).alias("theoretical"))


def mandelbrot(ranks: DataFrame, b: float = 1.0, rho: float = 2.7) -> DataFrame:
    """(rank, cnt, theoretical): (rank + rho)^-b, scaled to the sum of the counts."""
    power = ranks.withColumn("_p", F.pow(F.col("rank") + F.lit(float(rho)), F.lit(-float(b))))
    norm = F.broadcast(power.agg(F.sum("_p").alias("_norm"), F.sum("cnt").cast("double").alias("_all")))  # a single row
    return power.crossJoin(norm).select("rank", "cnt", (F.col("_all") / F.col("_norm") * F.col("_p")).alias("theoretical"))


def grid() -> list[tuple[float, float]]:
    """The exponents and shifts that the fit tries: steps are added up, so that rounding ends the loops one early."""
    def steps(start: float, stop: float, step: float) -> list[float]:
        out = []
        while start <= stop:
            out.append(start)
            start += step
        return out

    return [(b, rho) for b in steps(0.8, 1.5, 0.05) for rho in steps(1.0, 5.0, 0.2)]


def mandelbrot_fit(ranks: DataFrame, window: int = 1000) -> DataFrame:
    """One row (b, rho, p, error): the grid point of least mean squared difference of the logarithms (plus one) over the
    first ``window`` ranks, the first in grid order among equals. The scale uses all ranks.

    The sums over all ranks, one for each of the 280 grid points, are made batch by batch in NumPy, one row of sums for each
    task; those few rows are added up, and then only ``window`` ranks meet the grid."""
    points = grid()
    spark = ranks.sparkSession

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms, total = np.zeros(len(points)), 0.0
        for batch in batches:
            rank = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            norms += [np.power(rank + rho, -b).sum() for b, rho in points]
            total += batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(points)), pa.int32()), pa.array(norms), pa.array([total] * len(points))], names=["i", "_norm", "_all"])

    listed = F.broadcast(spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(points)], "i int, b double, rho double"))
    partial = ranks.select("rank", "cnt").mapInArrow(sums, "i int, _norm double, _all double")
    norms = partial.groupBy("i").agg(F.sum("_norm").alias("_norm"), F.sum("_all").alias("_all")).join(listed, "i")
    near = ranks.where(F.col("rank") <= window).select("rank", "cnt")
    theory = F.pow(F.col("rank") + F.col("rho"), -F.col("b")) / F.col("_norm") * F.col("_all")
    gap = F.log(F.col("cnt") + 1) - F.log(theory + 1)
    errors = near.crossJoin(F.broadcast(norms)).groupBy("i", "b", "rho").agg(F.avg(gap * gap).alias("error"), F.max("cnt").alias("_first"))
    best = errors.orderBy("error", "i").limit(1)
    return best.select("b", "rho", (F.col("_first") * F.pow(1 + F.col("rho"), F.col("b"))).alias("p"), "error")


#: Zones of ranks for the comparison with a law: first rank, last rank.
ZONES = [(1, 10), (11, 100), (101, 1000), (1001, None)]


def deviation(theory: DataFrame) -> DataFrame:
    """(zone, pct, direction): for each zone of ranks that has any, the mean of |cnt - theoretical| / theoretical in per
    cent, and whether the counts of the zone are above or below the law in sum."""
    zone = F.when(F.col("rank") <= 10, 1).when(F.col("rank") <= 100, 2).when(F.col("rank") <= 1000, 3).otherwise(4)
    off = F.when(F.col("theoretical") > 0, F.abs(F.col("cnt") - F.col("theoretical")) / F.col("theoretical")).otherwise(0.0)
    by = theory.groupBy(zone.alias("zone")).agg(F.round(F.avg(off) * 100, 1).alias("pct"), F.sum("cnt").alias("_c"), F.sum("theoretical").alias("_t"))
    return by.select("zone", "pct", F.when(F.col("_c") > F.col("_t"), "above").otherwise("below").alias("direction"))
