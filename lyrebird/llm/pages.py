"""Main bodies of pages (problem 5): tree scoring per page, then removal of lines that sites repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.blocks import DIGITS, HEADINGS, main_blocks, parse, words
from lyrebird.plans.spread import spread
from lyrebird.plans.staging import staged

BLOCK = pa.struct([("key", pa.string()), ("words", pa.string()), ("mask", pa.int64()), ("body", pa.int64()), ("beside", pa.int64()), ("text", pa.string())])
SCHEMA = "page_id bigint, site bigint, blocks array<struct<key:string,words:string,mask:bigint,body:bigint,beside:bigint,text:string>>, outside array<bigint>"
ARROW = pa.schema([("page_id", pa.int64()), ("site", pa.int64()), ("blocks", pa.list_(BLOCK)), ("outside", pa.list_(pa.int64()))])
#: Lines of so many words are long.
LONG_WORDS = 6
#: A mask's last bits: whether the line is long (1), and what kind of element holds it (times 2).
LONG, TEXT, HEADING, ITEM, CELL = 1, 0, 1, 2, 3
_KINDS = dict.fromkeys(HEADINGS, HEADING) | dict.fromkeys(("li", "dt", "dd"), ITEM) | dict.fromkeys(("td", "th"), CELL)


def _h64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def site_of(url: str | None) -> str:
    """The registered name of the URL's host: its last two labels in lower case; '' if there is none."""
    if not url or "//" not in url:
        return ""
    host = url.split("//", 1)[1].split("/", 1)[0].split("?", 1)[0].split("#", 1)[0].rsplit("@", 1)[-1].split(":", 1)[0]
    return ".".join(host.lower().rstrip(".").split(".")[-2:])


def mask_of(joined: str, count: int, tag: str) -> int:
    """A line's words with every figure as zero, as a number, with its length and kind of element in the last bits."""
    return (_h64(DIGITS.sub("0", joined)) & ~7) | (2 * _KINDS.get(tag, TEXT)) | (LONG if count >= LONG_WORDS else 0)


#: Masks of lines that a worker has seen, as pages of a site share most of those outside their bodies; and how many it keeps.
_masks: dict[tuple[str, str], int | None] = {}
KEEP_MASKS = 100_000


def _outside_mask(text: str, tag: str) -> int | None:
    """The mask of a line, None if it has no word."""
    key = (text, tag)
    if key in _masks:
        return _masks[key]
    tokens = words(text)
    mask = mask_of(" ".join(tokens), len(tokens), tag) if tokens else None
    if len(text) < 300:
        if len(_masks) >= KEEP_MASKS:
            _masks.clear()
        _masks[key] = mask
    return mask


def page_row(source: str | None, url: str | None, with_text: bool = False) -> tuple[int, list[dict], list[int]]:
    """Site, candidate main blocks, and the masks of the lines outside them, of one page.

    ``body`` of a block is the mask of the longest block other than itself; ``beside`` that of the block before it, for
    the first that of the next. Blocks without a word have a null key and mask and are there only ``with_text``."""
    page = parse(source) if source else None
    kept = main_blocks(page) if page else []
    out: list[dict] = []
    sizes: list[tuple[int, int]] = []
    inside = {id(b) for b in kept}
    for block in kept:
        tokens = words(block.text)
        if tokens:
            joined = " ".join(tokens)
            mask = mask_of(joined, len(tokens), page.tags[block.node])
            sizes.append((len(joined), mask))
            out.append({"key": hashlib.md5(joined.encode()).hexdigest()[:16], "words": joined, "mask": mask, "text": block.text if with_text else None})
        elif with_text:
            out.append({"key": None, "words": "", "mask": None, "text": block.text})
    sizes.sort(reverse=True)
    worded = [b for b in out if b["mask"] is not None]
    for i, b in enumerate(worded):
        b["body"] = next((m for _, m in sizes if m != b["mask"]), None)
        b["beside"] = worded[i - 1]["mask"] if i else worded[1]["mask"] if len(worded) > 1 else None
    outside: dict[int, None] = {}
    if page:
        for block in page.blocks:
            if id(block) not in inside:
                mask = _outside_mask(block.text, page.tags[block.node])
                if mask is not None:
                    outside[mask] = None
    return _h64(site_of(url)), out, list(outside)


def _extract(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = [page_row(h, u, with_text) for h, u in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                columns = [pa.array([r[k] for r in rows], ARROW.field(k + 1).type) for k in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=ARROW)

    return run


def candidate_blocks(pages: DataFrame, page_id: str = "page_id", html: str = "html_content", url: str = "url", with_text: bool = False) -> DataFrame:
    """One row per page that has html: its site, the blocks that tree scoring keeps, in order, and the masks of the other
    lines. Null or empty html gives no row."""
    read = pages.where(F.length(html) > 0).select(F.col(page_id).cast("bigint").alias("page_id"), F.col(html).alias("html"), F.col(url).alias("url"))
    return spread(read).mapInArrow(_extract(with_text), SCHEMA)


def _kind(mask: str = "mask") -> Column:
    return F.shiftright(F.col(mask), 1).bitwiseAND(F.lit(3))


def repeated_lines(candidates: DataFrame, least: int = 3, share: float = 0.5, own: float = 0.8, often: float = 0.08, outweigh: int = 2, everywhere: int = 10) -> DataFrame:
    """(site, mask): the lines that belong to a site and not to its articles, by counts over all pages.

    A line is known by its words, figures set to zero, and the kind of element that holds it. Tree scoring has put it
    inside the main bodies of some pages and outside those of others. It is the site's

    - if at least ``least`` of the site's pages hold it inside, in at least ``share`` of them beside another longest block
      (for a long line: and beside another neighbour), and these are at least ``own`` of all pages with it (long lines) or
      ``often`` of the site's pages (lines outside headings, lists and tables). Copies and near copies of one article share
      longest blocks and neighbours, so that their common paragraphs stay;
    - if at least ``least`` of the site's pages hold it outside, more than ``outweigh`` times as many as inside (no cells
      of tables);
    - if that holds over all sites for ``everywhere`` pages (lines outside headings, lists and tables).

    Counts are partial sums first; only lines that occur inside often enough beside more than one longest block are
    counted by longest block.
    """
    inside = candidates.select("site", F.explode("blocks").alias("b")).select("site", "b.mask", "b.body", "b.beside").where("mask is not null")
    outside = candidates.select("site", F.explode("outside").alias("mask"))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    rows = inside.select("site", "mask", "body", one.alias("i"), none.alias("o")).unionByName(outside.select("site", "mask", F.lit(None).cast("bigint").alias("body"), none.alias("i"), one.alias("o")))
    counted = staged(rows.groupBy("site", "mask").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.min("body").alias("a"), F.max("body").alias("z")), "lines")
    # a line that is nowhere inside can't be taken out of a body
    total = counted.groupBy("mask").agg(F.sum("i").alias("gi"), F.sum("o").alias("go"), F.max("i").alias("most")).where((F.col("gi") > 0) & ((F.col("most") >= least) | (F.col("go") >= least)))
    both = staged(counted.where("i > 0").join(total, "mask").select("site", "mask", "i", "o", "a", "z", "gi", "go"), "totals")
    some = both.where((F.col("i") >= least) & (F.col("a") < F.col("z")))
    pages = candidates.where(F.size("blocks") > 0).groupBy("site").agg(F.count("*").alias("pages"))
    held = inside.where("body is not null").join(some.select("site", "mask"), ["site", "mask"], "left_semi").groupBy("mask", "site", "body").agg(F.count("*").alias("n"), F.min("beside").alias("beside"))
    by = held.groupBy("mask", "site", "beside").agg(F.sum("n").alias("n"), F.count("*").alias("bodies"))
    spread_ = by.groupBy("mask", "site").agg(F.sum("n").alias("n"), F.sum("bodies").alias("bodies"), F.count("*").alias("besides"))
    long_ = F.col("mask").bitwiseAND(F.lit(LONG)) == LONG
    differ = F.when(long_, F.least("bodies", "besides")).otherwise(F.col("bodies")) >= F.greatest(F.lit(least), share * F.col("n"))
    text = _kind() == TEXT
    notes = spread_.join(some.select("site", "mask", "gi"), ["site", "mask"]).join(pages, "site")
    notes = notes.where(differ & (F.col("n") >= least) & ((long_ & (F.col("n") >= own * F.col("gi"))) | (text & (F.col("n") >= often * F.col("pages")))))
    # the counts outside decide without a look at the bodies
    here = (_kind() != CELL) & (F.col("o") >= least) & (F.col("o") > outweigh * F.col("i"))
    all_over = text & (F.col("go") >= everywhere) & (F.col("go") > outweigh * F.col("gi"))
    return notes.select("site", "mask").unionByName(both.where(here | all_over).select("site", "mask"))  # a line may be there twice


def main_bodies(pages: DataFrame, page_id: str = "page_id", html: str = "html_content", url: str = "url", with_text: bool = False) -> DataFrame:
    """(row, page_id, blocks): the main blocks of each page in order, each with its key, its words joined by blanks and, if
    asked for, its text; ``row`` is a number of its own for each row.

    The pages are parsed once; what that gives is kept as a table, read again for the lines that sites repeat. Those are
    looked up by line, not by site, so that a site of any size is never one row or one task. Rows with null or empty html,
    or without a main body, give no row; repeated rows give repeated rows.
    """
    kept = staged(candidate_blocks(pages, page_id, html, url, with_text).withColumn("row", F.monotonically_increasing_id()), "blocks")
    # kept as a table, so that the planner knows its size before it chooses how to join
    lines = staged(repeated_lines(kept), "repeated")
    held = kept.select("row", "site", F.posexplode("blocks").alias("pos", "b")).select("row", "site", "pos", "b.mask").where("mask is not null")
    gone = staged(held.join(lines, ["site", "mask"], "left_semi").groupBy("row").agg(F.collect_list("pos").alias("gone")), "gone")  # at most a page's blocks
    free = F.filter("blocks", lambda b, i: F.col("gone").isNull() | ~F.array_contains("gone", i))
    fields = ("key", "words", "text") if with_text else ("key", "words")
    return kept.where(F.size("blocks") > 0).join(gone, "row", "left").select("row", "page_id", F.transform(free, lambda b: F.struct(*(b[f].alias(f) for f in fields))).alias("blocks")).where(F.size("blocks") > 0)


def p5_found(spark, sf_dir: str) -> DataFrame:
    """Every main block of every page: (page_id, block_key)."""
    bodies = main_bodies(spark.read.parquet(f"{sf_dir}/crawled.parquet"))
    return bodies.select("page_id", F.explode(F.transform("blocks", lambda b: b.key)).alias("block_key")).distinct()


def p5_text(spark, sf_dir: str) -> DataFrame:
    """The main body of every page as text, in whatever script: (page_id, text), blocks divided by empty lines."""
    bodies = main_bodies(spark.read.parquet(f"{sf_dir}/crawled.parquet"), with_text=True)
    return bodies.select("page_id", F.array_join(F.transform("blocks", lambda b: b.text), "\n\n").alias("text"))


QUERIES = {"p5_found": p5_found, "p5_text": p5_text}
ORACLE: dict[str, str] = {}
