"""Text extraction and tokens as Spark expressions (JVM side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Case folding of the engine: A-Z, А-Я and Ё only; every other character keeps its case.
UPPER = "".join(map(chr, [*range(65, 91), *range(0x410, 0x430), 0x401]))
LOWER = "".join(map(chr, [*range(97, 123), *range(0x430, 0x450), 0x451]))
ASCII_UPPER, ASCII_LOWER = UPPER[:26], LOWER[:26]
#: What becomes one blank when tags are taken out: script and style with their content, any tag, and a bare '>'. An
#: unclosed one reaches to the end. The same pattern works in Java's and RE2's regular expressions.
TAGS = r"(?is)<script.*?(?:</script[^>]*>|\z)|<style.*?(?:</style[^>]*>|\z)|<[^>]*(?:>|\z)|>"
#: The six characters that count as white space, spelt out because the engines' classes differ.
SPACES = r"[ \t\n\x0B\f\r]+"
LETTER = "[A-Za-z0-9А-Яа-яЁё]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(c: Column | str) -> Column:
    """Lower case of A-Z, А-Я, Ё."""
    return F.translate(_col(c), UPPER, LOWER)


def extract_text(html: Column | str) -> Column:
    """The text of a page: tags, scripts and styles become blanks, runs of white space one blank, none at the start.
    Entities aren't decoded; a blank at the end may stay. Null gives null."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(_col(html), TAGS, " "), SPACES, " "), "^ ", "")


def extract_title(html: Column | str) -> Column:
    """The page's title: the text between ``<title>`` (anywhere, else ``<title `` with attributes) and ``</title>``, cut
    at the first ' — ' and then at the first ' - ', neither trimmed nor decoded; else the text of the first ``<h1``;
    else 'Untitled'. Null gives 'Untitled'."""
    h = F.coalesce(_col(html), F.lit(""))
    low = F.translate(h, ASCII_UPPER, ASCII_LOWER)

    def between(start: Column, end: str) -> tuple[Column, Column]:
        """The text after the first '>' from ``start`` and before ``end``; whether both are there."""
        gt = _locate(F.lit(">"), h, start)
        stop = _locate(F.lit(end), low, gt + 1)
        there = (start > 0) & (gt > 0) & (stop > 0)
        return F.substring(h, gt + 1, stop - gt - 1), there

    exact, open_ = F.instr(low, "<title>"), F.instr(low, "<title ")
    title, has_title = between(F.when(exact > 0, exact).otherwise(open_), "</title>")
    head, has_head = between(F.instr(low, "<h1"), "</h1>")
    cut = F.substring_index(F.substring_index(title, " — ", 1), " - ", 1)
    return F.when(has_title, cut).when(has_head, extract_text(head)).otherwise("Untitled")


def _locate(what: Column, where: Column, start: Column) -> Column:
    return F.call_function("locate", what, where, start)


def tokens(text: Column | str, min_length: int = 2, lowercase: bool = True, stopwords: list[str] | None = None) -> Column:
    """The maximal runs of a-z 0-9 а-я ё of at least ``min_length`` characters, in order, repeats kept; any other
    character separates. ``stopwords`` are left out if given. Null gives null, no token an empty array."""
    c = normalize(text) if lowercase else _col(text)
    letters = "[a-z0-9а-яё]" if lowercase else LETTER
    found = F.regexp_extract_all(c, F.lit(letters + ("+" if min_length <= 1 else f"{{{min_length},}}")), F.lit(0))
    if stopwords:
        return F.filter(found, lambda t: ~t.isin(stopwords))
    return found


#: Stop words, Russian and English. Fixed values.
STOP_WORDS = (
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только её мне было вот от меня ещё "
    "нет о из ему для при без до под над об про это этот эта эти был была были быть есть или также году года лет который "
    "которая которое которые где когда если чем the a an and or but in on at to for of with is was are were been be have "
    "has had it its"
).split()


def without_numbers(found: Column) -> Column:
    """The tokens that aren't digits alone."""
    return F.filter(found, lambda t: ~t.rlike("^[0-9]+$"))


def html_escape(c: Column | str) -> Column:
    """< > & and the double quote as entities."""
    out = _col(c)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def url_decode(c: Column | str) -> Column:
    """%XX and + decoded. A per cent sign followed by two characters of which only the first is a hexadecimal digit stands,
    with both, for the character of that number; one followed by anything else, or by fewer than two, stays."""
    parts = F.regexp_extract_all(_col(c), F.lit(r"(?s)%[0-9A-Fa-f]{2}|%[0-9A-Fa-f][^0-9A-Fa-f]|%|[^%]+"), F.lit(0))
    known = F.transform(
        parts,
        lambda x: F.when(x.rlike("^%[0-9A-Fa-f]{2}$") | ~F.startswith(x, F.lit("%")), x).when(F.char_length(x) == 1, F.lit("%25")).otherwise(F.concat(F.lit("%0"), F.substring(x, 2, 1))),
    )
    plain = ~F.contains(_col(c), F.lit("%"))
    return F.when(plain, F.translate(_col(c), "+", " ")).otherwise(F.coalesce(F.try_url_decode(F.array_join(known, "")), _col(c)))


def content_hash(c: Column | str) -> Column:
    """SHA-256 of the text's UTF-8 bytes in lower-case hex."""
    return F.sha2(_col(c), 256)
