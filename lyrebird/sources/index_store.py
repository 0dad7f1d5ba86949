"""Writing and opening an index: Parquet tables, and one binary file for exchange."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lyrebird.operators.index import Index

FORMAT, VERSION = "lyrebird-index", 1


def write_index(index: Index, path: str) -> None:
    """Documents, postings sorted and ranged by term (so that a lookup reads few row groups), inverted lists, statistics
    and, last of all, the marker that makes the index valid."""
    spark = index.docs.sparkSession
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    index.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")
    meta = spark.createDataFrame([(FORMAT, VERSION)], "format string, version int")
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def open_index(spark: SparkSession, path: str) -> Index:
    """The index at ``path``; ValueError if its marker is missing or of another format or version. Nothing is loaded:
    lookups push their terms down to the files."""
    try:
        meta = spark.read.schema("format string, version int").json(f"{path}/meta").first()
    except AnalysisException as e:  # there is no such folder; what else goes wrong isn't taken for that
        raise ValueError(f"no index at {path}") from e
    if meta is None or meta["format"] != FORMAT or meta["version"] != VERSION:
        raise ValueError(f"no index of this format at {path}")
    read = spark.read
    return Index(read.parquet(f"{path}/docs"), read.parquet(f"{path}/postings"), read.parquet(f"{path}/stats"))


#: The binary file: marker, header of 32 bytes (marker, version 1.0, flags, documents, terms, reserved, offset of the
#: documents), documents (id, length and bytes of title and url), terms (count; length and bytes, df, ids). Fixed values.
MARKER, HEADER = 0x49445831, struct.Struct("<IHHIIIIQ")


def write_binary(index: Index, path: str) -> None:
    """One file for programs that read the binary format. It is written by the driver from streams of rows, a partition
    at a time; lengths that the format can't hold raise ValueError."""
    documents, terms = index.docs.count(), index.postings.select("term").distinct().count()
    with open(path, "wb") as out:
        out.write(HEADER.pack(MARKER, 1, 0, 0, documents, terms, 0, HEADER.size))
        for r in index.docs.orderBy("doc_id").toLocalIterator():
            out.write(struct.pack("<I", r["doc_id"]) + _text(r["title"], "<H") + _text(r["url"], "<H"))
        out.write(struct.pack("<I", terms))
        for r in index.inverted().orderBy("term").toLocalIterator():
            ids = r["postings"]
            out.write(_text(r["term"], "<B") + struct.pack(f"<I{len(ids)}I", len(ids), *ids))


def _text(text: str, size: str) -> bytes:
    raw = (text or "").encode()
    if len(raw) >= 1 << (8 * struct.calcsize(size)):
        raise ValueError(f"too long for the binary format: {len(raw)} bytes")
    return struct.pack(size, len(raw)) + raw


def _read(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        head = f.read(HEADER.size)
        if len(head) < HEADER.size or HEADER.unpack(head)[0] != MARKER:
            raise ValueError(f"no index file: {path}")
        documents = HEADER.unpack(head)[4]

        def text(size: str) -> str:
            return f.read(struct.unpack(size, f.read(struct.calcsize(size)))[0]).decode()

        for _ in range(documents):
            (doc_id,) = struct.unpack("<I", f.read(4))
            yield "doc", doc_id, text("<H"), text("<H")
        (terms,) = struct.unpack("<I", f.read(4))
        for _ in range(terms):
            term = text("<B")
            (n,) = struct.unpack("<I", f.read(4))
            yield "term", term, list(struct.unpack(f"<{n}I", f.read(4 * n)))


def read_binary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(docs, postings) of a binary file on a path of the driver, through whose memory it goes: a format for exchange, not for
    corpora. ValueError if the marker is wrong."""
    docs, lists = [], []
    for row in _read(path):
        (docs if row[0] == "doc" else lists).append(row[1:])
    d = spark.createDataFrame(docs, "doc_id bigint, title string, url string")
    p = spark.createDataFrame(lists, "term string, ids array<bigint>")
    return d, p.select("term", F.explode("ids").alias("doc_id"))


def load_config(path: str) -> dict:
    """Settings of a JSON or, where PyYAML is installed, YAML file, with the defaults of the crawl filled in."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        config = json.loads(text)
    except ValueError:
        import yaml

        config = yaml.safe_load(text) or {}
    db = {"host": "localhost", "port": 27017, "database": "", "collection": "documents", "username": "", "password": ""} | (config.get("db") or {})
    logic = {"delay_between_requests": 5.0, "max_pages": 0, "recheck_interval_days": 7, "respect_robots_txt": True, "max_depth": 10, "restore_queue_from_saved": True, "sources": []} | (config.get("logic") or {})
    return {"db": db, "logic": logic}


def store_uri(db: dict) -> str:
    """The address of a document store; user and password only if both are there."""
    who = f"{db['username']}:{db['password']}@" if db.get("username") and db.get("password") else ""
    return f"mongodb://{who}{db['host']}:{db['port']}"


DOCUMENT = "url string, html_content string, source_name string, crawl_date bigint, content_hash string"


def read_documents(spark: SparkSession, path: str, limit: int | None = None, columns: tuple[str, ...] = ("url", "html_content")) -> DataFrame:
    """Stored pages from Parquet, a JSON array or JSON lines, only the columns asked for; a missing field is ''."""
    if path.endswith((".json", ".jsonl")):
        df = spark.read.schema(DOCUMENT).option("multiLine", path.endswith(".json")).json(path)
    else:
        df = spark.read.parquet(path)
    out = df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if df.schema[c].dataType == T.StringType() else F.col(c) for c in columns))
    return out if limit is None else out.limit(limit)


def read_store(spark: SparkSession, db: dict) -> DataFrame:
    """Stored pages through the document store's Spark connector, where it is installed."""
    return spark.read.format("mongodb").option("connection.uri", store_uri(db)).option("database", db["database"]).option("collection", db["collection"]).load()
