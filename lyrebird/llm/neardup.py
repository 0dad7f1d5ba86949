"""Near-duplicate records (problem 1): a set similarity join by grouped prefixes."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyrebird.llm.pages import main_bodies
from lyrebird.plans.staging import staged


#: Every so many-th set, by hash, is looked at to find hot tokens; those in more than that share of them are hot, at most so
#: many. This only chooses the way its rows are dealt; no token and no row is left out.
HOT_EVERY, HOT_SHARE, MOST_HOT = 64, 0.01, 100_000


def _ceil_share(n: Column, num: Column, den: Column) -> Column:
    """ceil(num / den * n) in whole numbers."""
    return F.floor((n * num + (den - 1)) / den)


def _pick(values: list, number: Column) -> Column:
    """The value with that number."""
    out = F.lit(values[0])
    for i, v in enumerate(values[1:], 1):
        out = F.when(number == i, F.lit(v)).otherwise(out)
    return out


def counted_tokens(sets: DataFrame, every: int = HOT_EVERY, share: float = HOT_SHARE) -> DataFrame:
    """(cls, n, token, df) of the tokens that occur in more than one set; df is the number of sets, for hot tokens that number
    as the sample gives it, which is all that an order of the tokens needs.

    Rows are brought together by token, once. A token of very many sets would make that one task's work. Such tokens are known
    from a sample of the sets (at most the mean size of a set divided by ``share``, and ``MOST_HOT``, so the list can be sent
    to all); as three sampled sets or more have them, they aren't alone, and their rows are dealt by token and set."""
    # the outer explode: for the other the planner would filter on the size of the array, for which it makes all sets twice
    each = F.explode_outer("tokens").alias("token")
    picked = sets.where(F.pmod(F.xxhash64("cls"), F.lit(every)) == 0)
    least = F.broadcast(picked.agg(F.greatest(F.lit(2.0), F.count("*") * F.lit(share)).alias("least")))  # a single row
    often = picked.select(each).groupBy("token").agg(F.count("*").alias("k")).where("token is not null")
    hottest = often.crossJoin(least).where("k > least").orderBy(F.desc("k"), "token").limit(MOST_HOT)
    hot = staged(hottest.select("token", (F.col("k") * every).alias("about")), "hot")
    rows = sets.select("cls", "n", each).join(F.broadcast(hot), "token", "left").where("token is not null")
    # one number to deal and sort by: should that of a hot row be another token's too, that token isn't taken for a lone one
    key = F.when(F.col("about").isNull(), F.col("token")).otherwise(F.xxhash64("token", "cls"))
    dealt = rows.select("cls", "n", key.alias("key"), F.when(F.col("about").isNotNull(), F.col("token")).alias("hot"))
    counted = dealt.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("k > 1 or hot is not null")
    known = counted.join(F.broadcast(hot.withColumnRenamed("token", "hot")), "hot", "left")
    return known.select("cls", "n", F.coalesce("hot", "key").alias("token"), F.coalesce("about", "k").alias("df"))


def similar_classes(sets: DataFrame, threshold: Fraction | list[Fraction], every: int = HOT_EVERY) -> DataFrame:
    """(a, b): pairs of classes, a < b, whose token sets have a Jaccard similarity of at least ``threshold``.

    ``sets``: (cls bigint unique, tokens array<bigint> of distinct values, not empty). With several thresholds there is a
    column ``f``, the number of each set's threshold; only sets with the same number are compared. So several collections go
    through one plan.

    Tokens are put in one order for all sets, rarest first. Two sets can only reach the threshold if they share a token
    among the first ``n - ceil(threshold * n) + 1`` of each. A token that occurs in one set only can't be shared, so
    those, which come first, use up places of the prefix and are then left out of everything else: a set that shares
    little has no prefix left and costs nothing more. Sets of the same size with the same prefix form one group; groups
    are joined on the tokens of their prefixes and on a bucket of their sizes (the larger of two similar sets lies in the
    bucket of the smaller or in the next), with the filters on length and position, and only then are the pairs of groups
    expanded to their members and verified on the whole sets. A prefix never holds a common token unless the set
    has nothing rarer, and no token, pair or group is left out for its frequency.
    """
    ts = threshold if isinstance(threshold, list) else [threshold]
    # a set's size with the number of its threshold, as one number
    f = F.col("f") if len(ts) > 1 else F.lit(0)
    sized = sets.select("cls", (F.size("tokens").cast("bigint") * len(ts) + f).alias("n"), "tokens")
    ordered = counted_tokens(sized, every).groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct(F.col("df"), F.col("token")))).alias("o"))
    number, size = F.pmod(F.col("n"), F.lit(len(ts))).cast("int"), F.floor(F.col("n") / len(ts)).cast("int")
    shared = staged(ordered.select("cls", number.alias("f"), size.alias("n"), F.transform("o", lambda x: x.token).alias("tokens")), "shared")
    num, den = _pick([t.numerator for t in ts], F.col("f")), _pick([t.denominator for t in ts], F.col("f"))

    alone = F.col("n") - F.size("tokens")
    places = F.col("n") - _ceil_share(F.col("n"), num, den) + 1 - alone
    short = shared.withColumn("alone", alone).withColumn("k", places.cast("int")).where("k > 0")
    grouped = short.withColumn("prefix", F.slice("tokens", F.lit(1), F.least(F.col("k"), F.size("tokens"))))
    # the prefix with the size settles the group; members keep their own number
    groups = grouped.groupBy("f", "n", "prefix").agg(F.min("cls").alias("g"), F.first("alone").alias("alone"))
    members = staged(grouped.join(groups.select("f", "n", "prefix", "g"), ["f", "n", "prefix"]).select("g", "cls", "f", "n", "alone", "prefix"), "members")

    lead = members.where(F.col("g") == F.col("cls"))  # a group's first member stands for it
    at = lead.select("g", "f", "n", "alone", F.posexplode("prefix").alias("pos", "token")).withColumn("pos", F.col("pos") + F.col("alone")).drop("alone")
    width = _pick([math.log(t.denominator / t.numerator) if t < 1 else 1e-6 for t in ts], F.col("f"))
    at = at.withColumn("bucket", F.floor(F.log("n") / width + F.lit(1e-9)))
    left = at.select("token", "f", F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"), F.col("g").alias("ga"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    right = at.select("token", "f", "bucket", F.col("g").alias("gb"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    na, nb = F.col("na"), F.col("nb")  # the smaller, or of equal ones the first, is on the left
    need = _ceil_share(na + nb, num, den + num)
    room = F.least(na - F.col("pa"), nb - F.col("pb"))
    ordered_pair = (na < nb) | ((na == nb) & (F.col("ga") < F.col("gb")))
    candidates = left.join(right, ["token", "f", "bucket"]).where(ordered_pair & (na * den >= nb * num) & (room >= need)).select("ga", "gb").distinct()

    ma, mb = members.select(F.col("g").alias("ga"), F.col("cls").alias("x")), members.select(F.col("g").alias("gb"), F.col("cls").alias("y"))
    across = candidates.join(ma, "ga").join(mb, "gb").select("x", "y")
    within = ma.join(mb, F.col("ga") == F.col("gb")).where("x < y").select("x", "y")
    pairs = across.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    sa = shared.select(F.col("cls").alias("a"), F.col("f"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    sb = shared.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    verified = pairs.join(sa, "a").join(sb, "b").withColumn("c", common).where(F.col("c") * den >= (na + nb - F.col("c")) * num)
    return verified.select("a", "b")


@dataclass
class Collection:
    """Texts (id bigint, text string) to compare, how they are cut into sets, and from which similarity on. A column ``row``,
    if there is one, is a number that each row of the texts always has and no other.

    ``tokens`` turns (cls, text) into (cls, tokens array<bigint>, distinct, not empty)."""

    texts: DataFrame
    tokens: Callable[[DataFrame], DataFrame]
    threshold: Fraction


def near_duplicates(collections: list[Collection]) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts and the similar pairs of classes, of several collections in one pass: (f, id, cls), f being the
    number of the collection, and (a, b).

    Copies of a text form one class, however many, before anything else is done. Null texts are left out; an id that comes
    with several texts is in several classes."""
    rows = None
    for f, c in enumerate(collections):
        texts = c.texts if "row" in c.texts.columns else staged(c.texts.withColumn("row", F.monotonically_increasing_id()), "texts")
        part = texts.where("text is not null").select(F.lit(f).alias("f"), "row", "id", "text")
        rows = part if rows is None else rows.unionByName(part)
    # narrow rows settle the classes; then each class's text is looked up, and no other text is moved
    signed = staged(rows.select("f", "row", "id", F.unhex(F.md5("text")).alias("sig")), "signed")
    first = staged(signed.groupBy("f", "sig").agg(F.min("row").alias("row")).withColumn("cls", F.monotonically_increasing_id()), "first")
    classes = staged(rows.select("f", "row", "text").join(first.select("f", "row", "cls"), ["f", "row"]).select("f", "cls", "text"), "classes")
    sets = None
    for f, c in enumerate(collections):
        part = c.tokens(classes.where(F.col("f") == f).select("cls", "text")).select("cls", "tokens", F.lit(f).alias("f"))
        sets = part if sets is None else sets.unionByName(part)
    membership = signed.join(first.select("f", "sig", "cls"), ["f", "sig"]).select("f", "id", "cls").distinct()
    return staged(membership, "membership"), similar_classes(sets, [c.threshold for c in collections])


def id_pairs(membership: DataFrame, classes: DataFrame) -> DataFrame:
    """(f, page_a, page_b): the pairs of different ids in one class or in two similar classes, the smaller first."""
    m = membership
    a, b = m.select("f", F.col("cls").alias("a"), F.col("id").alias("x")), m.select(F.col("cls").alias("b"), F.col("id").alias("y"))
    across = classes.join(a, "a").join(b, "b").where("x <> y").select("f", "x", "y")
    several = m.groupBy("cls").count().where("count > 1").select("cls")
    inside = m.join(several, "cls")
    within = inside.select("cls", "f", F.col("id").alias("x")).join(inside.select("cls", F.col("id").alias("y")), "cls").where("x < y").select("f", "x", "y")
    return across.unionByName(within).select("f", F.least("x", "y").alias("page_a"), F.greatest("x", "y").alias("page_b")).distinct()


def word_count(text: str) -> Column:
    """The number of words of a text of words joined by single blanks."""
    return F.when(F.col(text) == "", 0).otherwise(F.length(text) - F.length(F.translate(text, " ", "")) + 1)


def shingles(size: int) -> Callable[[DataFrame], DataFrame]:
    """Turns (cls, text of words joined by blanks) into the distinct hashes of ``size`` consecutive words."""

    def of(classes: DataFrame) -> DataFrame:
        # one function for each step: an array that a lambda refers to must be a column, or it is made for each element
        split = classes.select("cls", F.split("text", " ").alias("w"))
        shifted = [F.slice("w", F.lit(1 + k), F.greatest(F.lit(0), F.size("w") - (size - 1))) for k in range(size)]
        return split.select("cls", F.array_distinct(F.transform(F.arrays_zip(*(s.alias(f"s{k}") for k, s in enumerate(shifted))), lambda z: F.xxhash64(z))).alias("tokens"))

    return of


def word_hashes(classes: DataFrame) -> DataFrame:
    """Turns (cls, text of distinct words joined by blanks) into the hashes of the words."""
    return classes.select("cls", F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("tokens"))


_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
_URL_WORD = re.compile("[a-z0-9а-яё]+")


def url_words(url: str | None) -> str | None:
    """The distinct words of a URL's path, sorted and joined by blanks; None for a null URL."""
    if url is None:
        return None
    rest = _SCHEME.sub("", url.strip(), count=1)
    if rest.startswith("//"):
        rest = rest[2:]
        cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
        rest = rest[cut:]
    path = rest.split("#", 1)[0].split("?", 1)[0]
    if "%" in path:
        path = unquote_to_bytes(path).decode("utf-8", "replace")
    return " ".join(sorted(set(_URL_WORD.findall(path.replace("İ", "\0").replace("K", "\0").lower()))))


def _url_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([url_words(u) for u in batch.column(1).to_pylist()], pa.string())], names=["id", "text"])


def articles(pages: DataFrame, threshold: Fraction = Fraction(3, 5), words: int = 3, least: int = 30) -> Collection:
    """The articles of ``least`` words or more of pages, by their word shingles."""
    bodies = main_bodies(pages)
    text = F.concat_ws(" ", F.transform("blocks", lambda b: b.words))
    texts = bodies.select("row", F.col("page_id").alias("id"), text.alias("text")).where(word_count("text") >= max(least, words))
    return Collection(texts, shingles(words), threshold)


def url_paths(docs: DataFrame, threshold: Fraction = Fraction(3, 4), least: int = 6) -> Collection:
    """The documents' URLs with ``least`` words or more in their path, by these words."""
    read = docs.select(F.col("doc_id").cast("bigint").alias("id"), "url").where("url is not null").distinct()
    texts = read.mapInArrow(_url_batches, "id bigint, text string")
    return Collection(texts.where(word_count("text") >= least), word_hashes, threshold)


FIELDS = ("html_content", "url")


def _found(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates([articles(spark.read.parquet(f"{sf_dir}/crawled.parquet")), url_paths(spark.read.parquet(f"{sf_dir}/docinfo.parquet"))])


def p1_found(spark, sf_dir: str) -> DataFrame:
    """All pairs of pages with nearly the same article, and of documents with nearly the same URL."""
    return id_pairs(*_found(spark, sf_dir)).select(_pick(list(FIELDS), F.col("f")).alias("field"), "page_a", "page_b")


def representatives(membership: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same result without the pairs inside classes: (f, id, representative), the representative being the smallest id
    with the same text, and (f, a, b), the similar pairs of representatives, the smaller first."""
    first = membership.groupBy("f", "cls").agg(F.min("id").alias("representative"))
    of = membership.join(first, ["f", "cls"]).select("f", "id", "representative").distinct()
    a, b = first.select("f", F.col("cls").alias("a"), F.col("representative").alias("x")), first.select(F.col("cls").alias("b"), F.col("representative").alias("y"))
    links = classes.join(a, "a").join(b, "b").where("x <> y").select("f", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return of, links


def p1_classes(spark, sf_dir: str) -> DataFrame:
    """Every page with an article and every document with URL words, with the representative of its class of equal texts and
    the number of other classes that are similar to it."""
    of, links = representatives(*_found(spark, sf_dir))
    degree = links.select("f", F.explode(F.array("a", "b")).alias("representative")).groupBy("f", "representative").agg(F.count("*").alias("links"))
    return of.join(degree, ["f", "representative"], "left").select(_pick(list(FIELDS), F.col("f")).alias("field"), F.col("id").alias("page_id"), "representative", F.coalesce("links", F.lit(0)).alias("links"))


def p1_urls(spark, sf_dir: str) -> DataFrame:
    """All pairs of documents with nearly the same URL."""
    return id_pairs(*near_duplicates([url_paths(spark.read.parquet(f"{sf_dir}/docinfo.parquet"))])).select("page_a", "page_b")


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p1_urls": p1_urls}
ORACLE = {
    "p1_urls": r"""
with read as (select distinct doc_id, regexp_replace(trim(url), '[?#].*$', '', 's') as u from docinfo where url is not null),
paths as (select doc_id, url_decode(regexp_replace(regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*:', ''), '^//[^/]*', '')) as path from read),
sets as (select doc_id, list_distinct(regexp_extract_all(lower(path), '[a-z0-9а-яё]+')) as w from paths),
long as (select * from sets where len(w) >= 6)
select distinct least(a.doc_id, b.doc_id) as page_a, greatest(a.doc_id, b.doc_id) as page_b from long a join long b on a.doc_id < b.doc_id
where 4 * len(list_intersect(a.w, b.w)) >= 3 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))""",
}
