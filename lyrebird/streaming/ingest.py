"""Continuous crawl ingest with Structured Streaming: upsert by URL, and an index that follows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lyrebird.functions.text import content_hash, extract_text, extract_title, tokens
from lyrebird.operators.crawl import upsert

STORE = ["url", "html_content", "source_name", "crawl_date", "content_hash"]
ROWS = "url string, html_content string, source_name string, crawl_date bigint, content_hash string, action string"
#: Parts of a new store, by the hash of the URL. A batch rewrites those in which it has URLs.
PARTS = 64


class Store:
    """A table of pages in parts by the hash of their URL. Each batch writes anew the parts that it touches, then a pointer
    that names the folder of every part; the files of the other parts stay as they are.

    A batch that is run again after a failure (same number) finds its pointer written and changes nothing; what a failed
    batch wrote is never pointed to. Only a store without a folder for pointers is empty: one that can't be read raises."""

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _pointer(self) -> dict | None:
        """The last finished batch: its number, the number of parts, and the folder of each part. ValueError if there are
        pointers, but none that can be read."""
        if not self._exists(f"{self.path}/pointers"):
            return None
        read = self.spark.read.schema("batch bigint, parts int, folders map<string,string>, _bad string").option("columnNameOfCorruptRecord", "_bad")
        last = read.json(f"{self.path}/pointers").orderBy(F.desc("batch")).limit(1).collect()  # one row of at most PARTS folders
        if not last or last[0]["batch"] is None or last[0]["folders"] is None or last[0]["_bad"] is not None:
            raise ValueError(f"the pointers of the store at {self.path} can't be read")
        return last[0].asDict()

    def _read(self, pointer: dict, parts: list[int] | None = None) -> DataFrame:
        folders = sorted({f for k, f in pointer["folders"].items() if parts is None or int(k) in parts})
        if not folders:
            return self.spark.createDataFrame([], f"{ROWS}, batch bigint")
        return self.spark.read.schema(f"{ROWS}, batch bigint").parquet(*(f"{self.path}/{f}" for f in folders))

    def current(self) -> DataFrame:
        """The pages as of the last finished batch, with what it did to each."""
        pointer = self._pointer()
        if pointer is None:
            return self.spark.createDataFrame([], ROWS)
        latest = F.col("batch") == F.lit(pointer["batch"])
        return self._read(pointer).select(*STORE, F.when(latest, F.col("action")).otherwise("kept").alias("action"))

    def apply(self, batch: DataFrame, number: int) -> None:
        """Upserts a batch by URL. Unchanged pages get the new date only."""
        pointer = self._pointer()
        if pointer and pointer["batch"] >= number:
            return
        parts = pointer["parts"] if pointer else self.parts
        part = F.pmod(F.xxhash64("url"), F.lit(parts)).cast("int")
        rows = batch.where("url is not null").select(*STORE)
        touched = sorted(r[0] for r in rows.select(part.alias("p")).distinct().collect())  # at most ``parts`` numbers
        folders = dict(pointer["folders"]) if pointer else {}
        if touched:
            version = f"v{number}-{uuid.uuid4().hex[:8]}"
            old = self._read(pointer, touched) if pointer else self.spark.createDataFrame([], ROWS)
            merged = upsert(old.select(*STORE), rows).withColumn("batch", F.lit(number).cast("bigint")).withColumn("part", part)
            merged.repartition("part").write.partitionBy("part").parquet(f"{self.path}/{version}")
            folders |= {str(p): f"{version}/part={p}" for p in touched}
        line = self.spark.createDataFrame([(number, parts, folders)], "batch bigint, parts int, folders map<string,string>")
        line.coalesce(1).write.mode("append").json(f"{self.path}/pointers")

    def changed(self) -> DataFrame:
        """The pages that the last batch inserted or replaced: only these need new postings."""
        return self.current().where(F.col("action").isin("inserted", "replaced"))


def postings_delta(changed: DataFrame) -> DataFrame:
    """(url, term) of changed pages; it replaces all postings of their URLs."""
    words = tokens(extract_text("html_content"))
    return changed.where(F.length("html_content") > 0).select("url", F.explode(F.array_distinct(words)).alias("term"))


def apply_delta(postings: DataFrame, store_changes: DataFrame) -> DataFrame:
    """The postings (url, term) after a batch: those of changed URLs are taken out and made anew."""
    return postings.join(store_changes.select("url").distinct(), "url", "left_anti").unionByName(postings_delta(store_changes))


def read_landing(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream, at most ``files`` a batch; the hash is taken from the content."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return stream.withColumn("content_hash", content_hash("html_content"))


def ingest(stream: DataFrame, store: Store, checkpoint: str, available_now: bool = True, first: int = 0) -> StreamingQuery:
    """Starts the ingest; ``first`` is the number of the stream's first batch, for a store that other streams have fed
    before. Dates aren't compared between batches: the last writer of a URL wins, so late pages overwrite."""
    writer = stream.writeStream.foreachBatch(lambda df, n: store.apply(df, first + n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def token_counts(stream: DataFrame) -> DataFrame:
    """(token, cnt) of a stream of pages, for output mode complete or update."""
    return stream.select(F.explode(tokens(extract_text("html_content"))).alias("token")).groupBy("token").agg(F.count("*").alias("cnt"))


def pages_per_hour(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """(source_name, hour, pages) by crawl time, with a watermark: pages later than that don't count."""
    at = F.timestamp_seconds("crawl_date").alias("at")
    timed = stream.select("source_name", at).withWatermark("at", late)
    return timed.groupBy("source_name", F.window("at", "1 hour").alias("w")).agg(F.count("*").alias("pages")).select("source_name", F.col("w.start").alias("hour"), "pages")


def titles(stream: DataFrame) -> DataFrame:
    """(url, title) of a stream of pages."""
    return stream.select("url", extract_title("html_content").alias("title"))
