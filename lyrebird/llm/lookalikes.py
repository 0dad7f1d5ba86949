"""One consistent form for texts that look the same (problem 9): script-aware repair of look-alike letters."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.plans.spread import spread
from lyrebird.plans.staging import staged

#: Letters that look alike: Cyrillic and Greek ones beside their Latin twins, in the same order. Fixed values.
CYRILLIC = "АВЕЅІЈКМНОРСТУХЬЗаеѕіјорсухӏҮԚԜһԛԝ"
CYRILLIC_LATIN = "ABESIJKMHOPCTYXb3aesijopcyxlYQWhqw"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳν"
GREEK_LATIN = "ABEZHIKMNOPTYXocjv"
#: Without the pairs that a reader tells apart.
_TOLD_APART = frozenset("ЬЗν")
PAIRS = [(a, b) for a, b in zip(CYRILLIC + GREEK, CYRILLIC_LATIN + GREEK_LATIN) if a not in _TOLD_APART]
TO_LATIN = {ord(a): b for a, b in PAIRS}
TO_CYRILLIC = {}
TO_GREEK = {}
for _a, _b in PAIRS:
    (TO_CYRILLIC if "Ѐ" <= _a <= "ԯ" else TO_GREEK).setdefault(ord(_b), _a)
for _a, _b in PAIRS:
    if "Ѐ" <= _a <= "ԯ":
        if ord(_b) in TO_GREEK:
            TO_GREEK[ord(_a)] = TO_GREEK[ord(_b)]
    elif ord(_b) in TO_CYRILLIC:
        TO_CYRILLIC[ord(_a)] = TO_CYRILLIC[ord(_b)]
#: Letters with a twin in another script.
TWINS = frozenset(a for a, _ in PAIRS) | frozenset(b for _, b in PAIRS)

INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​‌‎‏‪-‮⁠-⁤⁦-⁯︀-️﻿\U000e0000-\U000e0fff]")
#: A joiner shows only between two pictures.
JOINER = re.compile("(?<![←-⯿\U0001f000-\U0001faff])‍|‍(?![←-⯿\U0001f000-\U0001faff])")
BLANKS = re.compile(r"[\s\u0085   -     　⠀ㅤ]+")
PLAIN_BLANKS = re.compile(r"[\t\n\v\f\r\x1c-\x1f]|  ")
#: Signs and forms that differ only in width or kind; everything else of compatibility is visible and stays.
COMPATIBLE = re.compile("[‐‑․-…Ⅰ-ⅿﬀ-ﭏ＀-￯µ−Ǉ-ǌǱ-ǳĲĳ∕∶]")
_SIGNS = {"‐": "-", "‑": "-", "−": "–", "∕": "/", "∶": ":"}
#: Letters of two of the scripts Latin, Greek and Cyrillic side by side.
_L, _O = "A-Za-zÀ-ɏḀ-ỿ", "Ͱ-ԯ"
_MARKS, _SIDES = "[\u0300-\u036f]*", (_L, "\u0370-\u03ff", "\u0400-\u052f")
MIXED = re.compile("|".join(f"[{a}]{_MARKS}[{''.join(b for b in _SIDES if b != a)}]" for a in _SIDES))
TOKEN = re.compile(f"[{_L}{_O}̀-ͯ]+")
#: Tokens whose letters all have twins.
_ANY = f"{_L}{_O}\u0300-\u036f"
TWINS_ALONE = re.compile(f"(?<![{_ANY}])(?=[^\\x00-\\x7f]|[A-Za-z]+[^\\x00-\\x7f])[{''.join(sorted(TWINS))}\u0300-\u036f]+(?![{_ANY}])")
WORD_SPLIT = f"[^{_L}{_O}̀-ͯ]+"
_SCRIPTS = (("latin", re.compile(f"[{_L}]")), ("cyrillic", re.compile("[Ѐ-ԯ]")), ("greek", re.compile("[Ͱ-Ͽ]")))
_TO = {"latin": TO_LATIN, "cyrillic": TO_CYRILLIC, "greek": TO_GREEK}


def plain(text: str) -> str:
    """Width, composition, invisible characters, ligatures and blanks brought to one form; letters stay as they are.
    A run of blanks becomes one, those at the ends go."""
    if text.isascii():
        return BLANKS.sub(" ", text).strip() if PLAIN_BLANKS.search(text) else text.strip()
    text = INVISIBLE.sub("", text)
    if "‍" in text:
        text = JOINER.sub("", text)
    if COMPATIBLE.search(text):
        text = COMPATIBLE.sub(lambda m: _SIGNS.get(m.group()) or unicodedata.normalize("NFKC", m.group()), text)
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return BLANKS.sub(" ", text).strip()


def dominant(token: str) -> str | None:
    """A token's script: the one with the most letters that have no twin in another script; with equally many, the one with
    the most letters, then the order Latin, Cyrillic, Greek. None if every letter has a twin: such a token has no script of
    its own."""
    best, most = None, (0, 0)
    for name, letters in _SCRIPTS:
        own = letters.findall(token)
        count = (sum(c not in TWINS for c in own), len(own))
        if count[0] and count > most:
            best, most = name, count
    return best


def repair(token: str) -> str | None:
    """A mixed-script token written in its dominant script, or None if that can't be done with look-alikes alone."""
    script = dominant(token)
    if script is None:
        return None
    out = token.translate(_TO[script])
    return None if MIXED.search(out) or out == token else out


def mixed_tokens(text: str) -> list[dict]:
    """The distinct mixed-script tokens of a plain text that can be repaired, with the repaired forms."""
    out = {}
    for token in TOKEN.findall(text):
        if token not in out and MIXED.search(token):
            out[token] = repair(token)
    return [{"token": k, "repaired": v} for k, v in out.items() if v is not None]


def key_of(form: str, mixed: bool = True) -> str:
    """What texts that look the same have in common: the form with the tokens that repair can't settle in Latin twins. All
    other tokens count as the repair has left them. Not ``mixed``: the form is known to have no mixed token."""
    if form.isascii():
        return form
    if mixed and MIXED.search(form):
        form = TOKEN.sub(lambda m: m.group().translate(TO_LATIN) if MIXED.search(m.group()) else m.group(), form)
    return TWINS_ALONE.sub(lambda m: m.group().translate(TO_LATIN), form)


_MIXED = pa.list_(pa.struct([("token", pa.string()), ("repaired", pa.string())]))


def _plain_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            texts = batch.column(1).to_pylist()
            forms = [None if t is None else plain(t) for t in texts]
            mixed = [bool(f) and MIXED.search(f) is not None for f in forms]
            marks = [None if t is None else hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(forms, pa.string()),
                    pa.array(marks, pa.binary()),
                    pa.array([mixed_tokens(f) if m else [] for f, m in zip(forms, mixed)], _MIXED),
                    pa.array([None if f is None else _look(key_of(f, m)) for f, m in zip(forms, mixed)], pa.binary()),
                ],
                names=["doc_id", "plain", "mark", "mixed", "look"],
            )


def _look(key: str) -> bytes:
    return hashlib.md5(key.encode("utf-8", "surrogatepass")).digest()


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms = []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            words = {p["token"]: p["repaired"] for p in found or ()}
            forms.append(TOKEN.sub(lambda m, w=words: w.get(m.group(), m.group()), text) if words else text)
        looks = pa.array([_look(key_of(f)) for f in forms], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string()), batch.column(2), looks], names=["doc_id", "form", "mark", "look"])


def consistent_forms(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repaired: bool = True) -> DataFrame:
    """(doc_id, form, mark, look): each document's consistent form, the MD5 of its text as it stands, and the MD5 by
    which texts that look the same are equal.

    Width, composition, invisible characters, ligatures and blanks are brought to one form. Then every token that mixes
    scripts is written in its dominant script, if the result occurs as a word elsewhere in the corpus; other tokens stay.
    ``look`` is taken from the form so repaired: a token with letters of one script only counts as it is written. Only
    tokens that repair can't settle (still mixed, as no vocabulary has the result, or of look-alikes alone) count by their
    Latin twins. So a wrong or a missing repair shows in the pairs. A null text has a null form and look, a blank text the
    form ''. Repeated rows give repeated rows. Not ``repaired``: without the repair, to measure what it does.

    The vocabulary is that of all documents. Only documents with mixed tokens go through the join with it.
    """
    read = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id bigint, plain string, mark binary, mixed array<struct<token:string,repaired:string>>, look binary"
    kept = staged(spread(read).mapInArrow(_plain_batches, schema), "plain")
    if not repaired:
        return kept.select("doc_id", F.col("plain").alias("form"), "mark", "look")
    # kept as a table, so that the planner knows its size: the corpus is shuffled for the vocabulary only if it is large
    wanted = kept.where(F.size("mixed") > 0).select("doc_id", "mark", F.explode("mixed").alias("m")).select("doc_id", "mark", "m.token", "m.repaired").distinct()
    candidates = staged(wanted.select(F.col("repaired").alias("word")).distinct(), "candidates")
    vocabulary = kept.where("plain <> ''").select(F.explode(F.split("plain", WORD_SPLIT)).alias("word")).join(candidates, "word", "left_semi").distinct()
    known = wanted.join(vocabulary, F.col("repaired") == F.col("word")).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("token", "repaired")).alias("repairs"))
    todo = kept.where(F.size("mixed") > 0).join(known, ["doc_id", "mark"], "left").select("doc_id", "plain", "mark", "repairs")
    done = todo.mapInArrow(_apply, "doc_id bigint, form string, mark binary, look binary")
    same = kept.where(F.size("mixed") <= 0).select("doc_id", F.col("plain").alias("form"), "mark", "look")
    return same.unionByName(done)


def same_look_pairs(forms: DataFrame) -> DataFrame:
    """(doc_a, doc_b): documents with the same look whose texts aren't the same string.

    Copies are first one class; only looks with two classes or more go on, and pairs are made between classes, so that
    a text copied any number of times is never paired with itself."""
    rows = staged(forms.where("form is not null and form <> ''").select("doc_id", "mark", "look"), "looks")  # read again and again
    several = rows.groupBy("look").agg(F.min("mark").alias("a"), F.max("mark").alias("z")).where("a <> z").select("look")
    members = rows.join(several, "look").distinct()
    classes = staged(members.select("look", "mark").distinct(), "classes")
    pairs = classes.join(classes.select("look", F.col("mark").alias("other")), "look").where("mark < other")
    first = members.select("look", "mark", F.col("doc_id").alias("x"))
    second = members.select("look", F.col("mark").alias("other"), F.col("doc_id").alias("y"))
    expanded = pairs.join(first, ["look", "mark"]).join(second, ["look", "other"]).where("x <> y")
    return expanded.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def p9_found(spark, sf_dir: str) -> DataFrame:
    """Pairs of documents that look the same but aren't the same string."""
    return same_look_pairs(consistent_forms(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def p9_forms(spark, sf_dir: str) -> DataFrame:
    """The consistent form of every document."""
    return consistent_forms(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "form", F.lower(F.hex("look")).alias("look"))


QUERIES = {"p9_found": p9_found, "p9_forms": p9_forms}
ORACLE: dict[str, str] = {}
