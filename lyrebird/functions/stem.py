"""A rule stemmer for Russian as Spark expressions, applied to distinct words, with the same rules as SQL text.

Each rule list is tried in its order, the first suffix that fits wins, and positions count in bytes as the rules do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOWELS = "аеиоуыэюяё"
#: The suffixes in the order in which they are tried. Fixed values.
GERUND = "ившись ывшись ивши ывши ив ыв".split()
GERUND_AFTER_A = "вшись вши в".split()
REFLEXIVE = "ся сь".split()
ADJECTIVE = "ими ыми его ого ему ому ее ие ые ое ей ий ый ой ем им ым ом их ых ую юю ая яя ою ею".split()
PARTICIPLE = "ивш ывш ующ".split()
VERB = "ейте уйте ила ыла ена ите или ыли ило ыло ено ует уют ены ить ыть ишь ую ей уй ил ыл им ым ен ят ит ыт ую ю".split()
VERB_AFTER_A = "ете йте ешь нно ла на ли ем ло но ет ют ны ть й л н".split()
NOUN = "иями ями ами ией иям ием иях ев ов ие ье ьи ей ой ий ям ем ам ом ах ях ию ью ия ья и ы ь ю у о а е й".split()
SUPERLATIVE = "ейше ейш".split()
DERIVATIONAL = "ость ост".split()


def _bytes(s: str) -> int:
    return len(s.encode())


def _cut(w: str, suffixes: list[str], start: str | None, after_a: bool = False) -> Column:
    """The number of characters that the first fitting suffix takes off, null if none fits."""
    word = F.col(w)
    found = []
    for s in suffixes:
        for lead in ("а", "я") if after_a else ("",):
            fits = F.endswith(word, F.lit(lead + s))
            if start:
                fits = fits & (F.octet_length(word) - _bytes(lead + s) >= F.col(start))
            found.append(F.when(fits, F.lit(len(s))))
    return F.coalesce(*found)


def _without(w: str, n: str) -> Column:
    return F.when(F.col(n).isNull(), F.col(w)).otherwise(F.expr(f"substring({w}, 1, char_length({w}) - {n})"))


def _region(w: Column, start: Column | None = None) -> Column:
    """Characters up to and with the first non-vowel after a vowel, from ``start`` on; 0 if there is none."""
    part = w if start is None else F.substring(w, start + 1, F.char_length(w))
    own = F.char_length(F.regexp_extract(part, f"(?s)^[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]", 0))
    return F.when(own == 0, 0).otherwise(own if start is None else own + start)


def stemmed(words: DataFrame, word: str = "word", stem: str = "stem") -> DataFrame:
    """The rows with the stem of ``word`` added. Words of fewer than four bytes, and words without a Cyrillic suffix,
    are their own stems; a null word has a null stem. Meant for distinct words, joined back by word."""
    names = words.columns
    df = words.withColumn("_w", F.col(word))
    w = F.col("_w")
    df = df.withColumn("_rv", 2 * F.char_length(F.regexp_extract(w, f"(?s)^[^{VOWELS}]*[{VOWELS}]", 0))).withColumn("_r1c", _region(w))
    df = df.withColumn("_r2", 2 * _region(w, F.col("_r1c")))
    # step 1: a gerund ends the step; else reflexive, then adjective (and participle), verb or noun
    df = df.withColumn("_g", F.coalesce(_cut("_w", GERUND, "_rv"), _cut("_w", GERUND_AFTER_A, "_rv", True)))
    df = df.withColumn("_n", _cut("_w", REFLEXIVE, "_rv")).withColumn("_b", _without("_w", "_n"))
    df = df.withColumn("_a", _cut("_b", ADJECTIVE, "_rv"))
    df = df.withColumn("_n", F.coalesce(_cut("_b", VERB, "_rv"), _cut("_b", VERB_AFTER_A, "_rv", True), _cut("_b", NOUN, "_rv")))
    df = df.withColumn("_v", _without("_b", "_n")).withColumn("_c", _without("_b", "_a"))
    df = df.withColumn("_n", _cut("_c", PARTICIPLE, None)).withColumn("_c", _without("_c", "_n"))
    df = df.withColumn("_x", F.when(F.col("_g").isNotNull(), _without("_w", "_g")).when(F.col("_a").isNotNull(), F.col("_c")).otherwise(F.col("_v")))
    # step 2
    df = df.withColumn("_n", _cut("_x", ["и"], "_rv")).withColumn("_x", _without("_x", "_n"))
    # step 3
    df = df.withColumn("_n", _cut("_x", DERIVATIONAL, "_r2")).withColumn("_x", _without("_x", "_n"))
    # step 4
    df = df.withColumn("_n", _cut("_x", SUPERLATIVE, "_rv")).withColumn("_x", _without("_x", "_n"))
    df = df.withColumn("_n", F.when(F.endswith("_x", F.lit("нн")), 1).when(F.endswith("_x", F.lit("ь")), 1)).withColumn("_x", _without("_x", "_n"))
    return df.select(*names, F.when(F.octet_length(F.col(word)) < 4, F.col(word)).otherwise(F.col("_x")).alias(stem))


def stem_sql(source: str, word: str = "word") -> str:
    """The same rules as a chain of common table expressions over ``source``; the last is ``stems(word, stem)``."""
    v = VOWELS

    def cut(w: str, suffixes: list[str], start: str | None, after_a: bool = False) -> str:
        whens = []
        for s in suffixes:
            for lead in ("а", "я") if after_a else ("",):
                room = f" and strlen({w}) - {_bytes(lead + s)} >= {start}" if start else ""
                whens.append(f"when suffix({w}, '{lead + s}'){room} then {len(s)}")
        return "case " + " ".join(whens) + " end"

    def off(w: str, n: str) -> str:
        return f"left({w}, length({w})::int - coalesce({n}, 0)::int)"

    region = f"length(regexp_extract({{}}, '(?s)^[^{v}]*[{v}]+[^{v}]'))"
    return f"""
s0 as (select distinct {word} as word from {source}),
s1 as (select word, 2 * length(regexp_extract(word, '(?s)^[^{v}]*[{v}]')) as rv, {region.format("word")} as r1c from s0),
s2 as (select *, {region.format("substr(word, (r1c + 1)::bigint)")} as own from s1),
s3 as (select *, case when own = 0 then 0 else 2 * (own + r1c) end as r2, coalesce({cut("word", GERUND, "rv")}, {cut("word", GERUND_AFTER_A, "rv", True)}) as g,
  {cut("word", REFLEXIVE, "rv")} as n from s2),
s4 as (select *, {off("word", "n")} as b from s3),
s5 as (select *, {cut("b", ADJECTIVE, "rv")} as a, coalesce({cut("b", VERB, "rv")}, {cut("b", VERB_AFTER_A, "rv", True)}, {cut("b", NOUN, "rv")}) as m from s4),
s6 as (select *, {off("b", "m")} as vv, {off("b", "a")} as c from s5),
s7 as (select *, {off("c", cut("c", PARTICIPLE, None))} as cc from s6),
s8 as (select *, case when g is not null then {off("word", "g")} when a is not null then cc else vv end as x from s7),
s9 as (select *, {off("x", cut("x", ["и"], "rv"))} as x2 from s8),
s10 as (select *, {off("x2", cut("x2", DERIVATIONAL, "r2"))} as x3 from s9),
s11 as (select *, {off("x3", cut("x3", SUPERLATIVE, "rv"))} as x4 from s10),
stems as (select word, case when strlen(word) < 4 then word else {off("x4", "case when suffix(x4, 'нн') or suffix(x4, 'ь') then 1 end")} end as stem from s11)"""
