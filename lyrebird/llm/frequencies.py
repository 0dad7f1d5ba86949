"""Frequencies of every distinct term (problem 3): recursive radix spilling with DuckDB."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.functions.text import LOWER, UPPER
from lyrebird.plans.spread import spread
from lyrebird.plans.staging import staged

#: Bits of a term's hash that each level of the partitioning takes.
BITS = 4
#: Rows that a task adds up in memory, and beyond which it splits a partition by the next bits; DuckDB's memory, in MB.
SPLIT_ROWS, MEMORY_MB = 500_000, 256
TERMS = pa.schema([("kind", pa.string()), ("term", pa.string()), ("h", pa.int64()), ("total", pa.int64()), ("records", pa.int64())])
TERMS_DDL = "kind string, term string, h bigint, total bigint, records bigint"
#: The kind of the rows that hold, instead of a term, a record and its number of distinct terms of each kind.
RECORD = "record:"


def _scratch() -> str:
    """A folder in the scratch space that Spark gives this executor for its own spills, for this task only."""
    places = (os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("LOCAL_DIRS") or "").split(",")
    root = next((p for p in places if p and os.path.isdir(p)), None)
    if root is None:
        raise RuntimeError("terms have to be spilled, but Spark's scratch folder (SPARK_LOCAL_DIRS) isn't known to this task")
    return tempfile.mkdtemp(prefix="radix-", dir=root)


def _connect(folder: str, memory_mb: int) -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"memory_limit": f"{memory_mb}MB", "temp_directory": f"{folder}/duck", "threads": 1, "preserve_insertion_order": False})


_SUM = "select kind, term, h, sum(total)::bigint as total, sum(records)::bigint as records from {} group by all"


class RadixSpill:
    """Sums of (kind, term) rows of any number in bounded memory.

    Up to ``split_rows`` rows are held and added up by DuckDB; if the sums still take more than half of that, all rows, these
    and those to come, go to disk by the next ``BITS`` bits of their term's hash. A partition of more than ``split_rows`` rows
    is read again in pieces and split by the bits after those; the others are aggregated by DuckDB, which works out of core
    itself. A partition that has one hash value only can't be split and is aggregated as it is. ``folder``: where to spill, or
    what gives that folder when it is needed."""

    def __init__(self, folder, split_rows: int = SPLIT_ROWS, memory_mb: int = MEMORY_MB, bits: int = BITS, shift: int = 0):
        self.place, self.split_rows, self.memory_mb, self.bits, self.shift = folder, split_rows, memory_mb, bits, shift
        self.memory = duckdb.connect(config={"threads": 1, "preserve_insertion_order": False})
        self.spilled: str | None = None

    def _sum(self, held: list[pa.Table]) -> pa.Table:
        rows = pa.concat_tables(held)  # noqa: F841 (read by the query)
        return self.memory.sql(_SUM.format("rows")).to_arrow_table().cast(TERMS)

    def split(self, batches: Iterator[pa.RecordBatch], shift: int, where: Path) -> dict[int, int]:
        """Writes the rows to one file for each value of the bits from ``shift`` on; the rows of each."""
        where.mkdir(parents=True)
        writers: dict[int, pq.ParquetWriter] = {}
        rows: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            numbers = (table.column("h").to_numpy() >> shift) & ((1 << self.bits) - 1)
            order = numbers.argsort(kind="stable")
            part, numbers = table.take(pa.array(order)).cast(TERMS), numbers[order]
            for value in sorted(set(numbers.tolist())):
                a, z = numbers.searchsorted(value), numbers.searchsorted(value, "right")
                if value not in writers:
                    writers[value] = pq.ParquetWriter(where / f"{value}.parquet", TERMS, compression="zstd")
                writers[value].write_table(part.slice(int(a), int(z - a)))
                rows[value] = rows.get(value, 0) + int(z - a)
        for w in writers.values():
            w.close()
        return rows

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        batches = iter(batches)
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]).cast(TERMS))
            rows += batch.num_rows
            if rows >= self.split_rows:
                held = [self._sum(held)]
                rows = held[0].num_rows
                if 2 * rows > self.split_rows:
                    self.spilled = self.place() if callable(self.place) else str(self.place)
                    self.duck = _connect(self.spilled, self.memory_mb)
                    first = iter(held[0].to_batches(65_536))
                    yield from self._run((b for part in (first, batches) for b in part), self.shift, Path(self.spilled) / "p")
                    return
        if held:
            yield from self._sum(held).to_batches(65_536)

    def _run(self, batches: Iterator[pa.RecordBatch], shift: int, where: Path) -> Iterator[pa.RecordBatch]:
        for value, rows in sorted(self.split(batches, shift, where).items()):
            file = where / f"{value}.parquet"
            if rows > self.split_rows and shift + self.bits < 64 and self._several(file):
                yield from self._run(pq.ParquetFile(file).iter_batches(65_536), shift + self.bits, where / str(value))
            else:
                yield from self.duck.sql(_SUM.format(f"read_parquet('{file}')")).to_arrow_table().cast(TERMS).to_batches(65_536)
            file.unlink()

    def _several(self, file: Path) -> bool:
        return self.duck.execute(f"select min(h) < max(h) from read_parquet('{file}')").fetchall()[0][0]


def _added(batches: Iterator[pa.RecordBatch], shift: int, split_rows: int, memory_mb: int) -> Iterator[pa.RecordBatch]:
    """The rows streamed through a RadixSpill, which gets a scratch folder if it needs one."""
    spill = RadixSpill(_scratch, split_rows, memory_mb, shift=shift)
    try:
        yield from spill.run(batches)
    finally:
        if spill.spilled:
            shutil.rmtree(spill.spilled, ignore_errors=True)


_FOLD = str.maketrans(UPPER, LOWER)
#: Blanks: those of Java's regular expressions and the non-breaking one.
_BLANKS = " \t\n\x0b\f\r\u00a0"


def fold_term(term: str) -> str:
    """A term's compared form: without blanks at both ends, A-Z, А-Я, Ё in lower case."""
    return term.strip(_BLANKS).translate(_FOLD)


def _hashes(terms: list[str]) -> np.ndarray:
    """A 64-bit hash of each term, the same on every machine."""
    return pd.util.hash_array(np.array(terms, dtype=object), categorize=False).view(np.int64) if terms else np.zeros(0, np.int64)


def _rows(kind: str, terms: list[str], total: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(terms), pa.string()), pa.array(terms, pa.string()), pa.array(_hashes(terms)), pa.array(total), pa.array(records)], schema=TERMS)


def count_batch(records: pa.Array, maps: dict[str, pa.Array], distinct: bool = True) -> Iterator[pa.RecordBatch]:
    """The sums of one batch of records: for each kind its folded terms with their total and their number of records, and, if
    ``distinct``, for each record with an id its number of distinct terms. Null maps, keys and counts and counts below 1 don't
    occur; several spellings of one term in a record are one."""
    names = [None if r is None else str(r) for r in records.to_pylist()]
    for kind, column in maps.items():
        offsets = np.asarray(column.offsets)
        lengths = np.where(np.asarray(column.is_null()), 0, np.diff(offsets))
        at = np.repeat(offsets[:-1] - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))  # entries of maps that aren't null
        of = np.repeat(np.arange(len(column)), lengths)
        keys, values = column.keys.take(pa.array(at)).dictionary_encode(), column.items.take(pa.array(at))
        n = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        index = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        good = (n > 0) & (index >= 0)
        of, n, index = of[good], n[good], index[good]
        numbers: dict[str, int] = {}
        code = np.array([numbers.setdefault(fold_term(k), len(numbers)) for k in keys.dictionary.to_pylist()] or [0], np.int64)
        size = max(len(numbers), 1)
        term = code[index]
        total = np.zeros(size, np.int64)
        np.add.at(total, term, n)
        once = np.unique(of * size + term)
        seen = np.bincount(once % size, minlength=size)
        there = np.flatnonzero(seen)
        terms = list(numbers)
        yield _rows(kind, [terms[i] for i in there.tolist()], total[there], seen[there].astype(np.int64))
        if distinct:
            own = np.bincount(once // size, minlength=len(column)).astype(np.int64)
            known = np.array([i for i, name in enumerate(names) if name is not None], np.int64)
            yield _rows(RECORD + kind, [names[i] for i in known.tolist()], own[known], np.ones(len(known), np.int64))


def partial_sums(records: DataFrame, record: str, kinds: dict[str, str], split_rows: int = SPLIT_ROWS, memory_mb: int = MEMORY_MB) -> DataFrame:
    """(kind, term, h, total, records) added up within each task, and the rows of ``RECORD`` kinds; kept as a table.

    ``records``: one row for each record, with its maps from term to count in the columns that ``kinds`` names. A record's
    terms are counted where the record is: maps don't cross the network, and a term of every record leaves a task once."""
    names = list(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.RecordBatch] = []  # rows of records go out as they come, a batch of them at a time

        def terms() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in count_batch(batch.column(0), {k: batch.column(1 + i) for i, k in enumerate(names)}):
                    if part.num_rows and part.column(0)[0].as_py().startswith(RECORD):
                        own.append(part)
                    else:
                        yield part

        counted = terms()
        for batch in _added(counted, 0, split_rows, memory_mb):
            yield batch
        yield from own

    read = spread(records.select(F.col(record).cast("bigint").alias("record"), *(F.col(kinds[k]).alias(f"m{i}") for i, k in enumerate(names))))
    return staged(read.mapInArrow(run, TERMS_DDL), "sums")


def term_frequencies(sums: DataFrame, split_rows: int = SPLIT_ROWS, memory_mb: int = MEMORY_MB) -> DataFrame:
    """(kind, term, total, records): for every distinct term its total count and the number of records with it, from the sums
    of the tasks. The exchange is the first level of the radix partitioning: it writes partitions by the hash to disk; each
    task then goes on with the bits after those. Every term is counted, however many there are."""
    dealt = sums.where(~F.startswith("kind", F.lit(RECORD))).repartition(F.col("kind"), F.shiftright("h", 52))
    return dealt.mapInArrow(lambda batches: _added(batches, 0, split_rows, memory_mb), TERMS_DDL).drop("h")


def latest_stats(stats: DataFrame) -> DataFrame:
    """One row for each stats_id: its row with the latest computed_at; among equals the one with the larger counts, then with
    the larger hash of its maps. Rows of null stats_id are left out.

    Which stats_id repeat is found on their column alone. The rows of the others are taken as they are, without a grouping;
    only the maps of repeated ones are grouped."""
    rows = stats.where("stats_id is not null")
    several = staged(rows.groupBy("stats_id").agg(F.count("*").alias("n")).where("n > 1").select("stats_id"), "several")
    of_maps = F.xxhash64(F.map_entries("token_freq"), F.map_entries("stem_freq"))
    ahead = F.struct("computed_at", "total_tokens", "unique_tokens", "unique_stems", "total_bytes", "total_documents", of_maps)
    best = rows.join(several, "stats_id", "left_semi").groupBy("stats_id").agg(F.max_by(F.struct("token_freq", "stem_freq"), ahead).alias("m"))
    alone = rows.select("stats_id", "token_freq", "stem_freq").join(several, "stats_id", "left_anti")
    return alone.unionByName(best.select("stats_id", "m.token_freq", "m.stem_freq"))


#: The maps of a row of statistics by the kind of their terms.
MAPS = {"token": "token_freq", "stem": "stem_freq"}


def marked(frequencies: DataFrame, records: DataFrame, common: float = 0.6) -> DataFrame:
    """The frequencies with ``rare`` (one record only) and ``common`` (more than that share of all records)."""
    n = records.agg(F.count("*").alias("all"))
    return frequencies.crossJoin(F.broadcast(n)).select(  # a single row
        "kind", "term", "total", "records", (F.col("records") == 1).alias("rare"), (F.col("records") > F.lit(common) * F.col("all")).alias("common")
    )


def differing_counts(index: DataFrame, sums: DataFrame) -> DataFrame:
    """The stats_id of index rows whose unique_terms isn't null and differs from the number of distinct tokens that
    occur in that stats_id (0 for a null map). Index rows of an unknown stats_id aren't checked."""
    own = sums.where(F.col("kind") == RECORD + "token").select(F.col("term").cast("bigint").alias("stats_id"), F.col("total").alias("distinct"))
    return index.where("unique_terms is not null").join(own, "stats_id").where(F.col("unique_terms") != F.col("distinct")).select("stats_id").distinct()


def _frequencies(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sums = partial_sums(latest_stats(spark.read.parquet(f"{sf_dir}/tokenizer_stats.parquet")), "stats_id", MAPS)
    return sums, marked(term_frequencies(sums), sums.where(F.col("kind") == RECORD + "token"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    """The rare and the common terms, and the stats_id whose unique_terms differ."""
    sums, terms = _frequencies(spark, sf_dir)
    marks = F.filter(F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common"))), lambda m: m.isNotNull())
    found = terms.where("rare or common").select("kind", "term", F.explode(marks).alias("mark"))
    wrong = differing_counts(spark.read.parquet(f"{sf_dir}/index_stats.parquet"), sums)
    return found.unionByName(wrong.select(F.lit("unique_terms").alias("kind"), F.col("stats_id").cast("string").alias("term"), F.lit("differs").alias("mark")))


def p3_frequencies(spark, sf_dir: str) -> DataFrame:
    """Every token and stem with its total count, its number of records and its marks."""
    return _frequencies(spark, sf_dir)[1]


_U = "'ABCDEFGHIJKLMNOPQRSTUVWXYZАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ', 'abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопрстуфхцчшщъыьэюяё'"
_SQL = f"""
with ranked as (select *, row_number() over (partition by stats_id order by computed_at desc nulls last, total_tokens desc nulls last,
    unique_tokens desc nulls last, unique_stems desc nulls last, total_bytes desc nulls last, total_documents desc nulls last) as rn
  from tokenizer_stats where stats_id is not null),
latest as (select * from ranked where rn = 1),
entries as (
  select stats_id, 'token' as kind, unnest(map_keys(token_freq)) as k, unnest(map_values(token_freq)) as n from latest
  union all select stats_id, 'stem', unnest(map_keys(stem_freq)), unnest(map_values(stem_freq)) from latest),
terms as (select kind, translate(trim(k), {_U}) as term, sum(n)::bigint as total, count(distinct stats_id) as records
  from entries where n > 0 group by all),
marks as (select kind, term, total, records, records = 1 as rare, records > 0.6 * (select count(*) from latest) as common from terms)
"""
QUERIES = {"p3_found": p3_found, "p3_frequencies": p3_frequencies}
ORACLE = {
    "p3_found": _SQL + f"""
select kind, term, 'rare' as mark from marks where rare
union all select kind, term, 'common' from marks where common
union all select distinct 'unique_terms', cast(i.stats_id as varchar), 'differs' from index_stats i join latest l using (stats_id)
  left join (select stats_id, count(distinct translate(trim(k), {_U})) as d from entries where kind = 'token' and n > 0 group by 1) c using (stats_id)
  where i.unique_terms is not null and i.unique_terms <> coalesce(c.d, 0)""",
    "p3_frequencies": _SQL + "select kind, term, total, records, rare, common from marks",
}
