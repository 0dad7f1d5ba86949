import pytest

from lyrebird.streaming.ingest import Store, apply_delta, ingest, pages_per_hour, postings_delta, read_landing, titles, token_counts

SCHEMA = "url string, html_content string, source_name string, crawl_date bigint"


def test_ingest(spark, tmp_path):
    land, store = f"file://{tmp_path}/land", Store(spark, f"file://{tmp_path}/store")
    spark.createDataFrame([("u1", "<p>one</p>", "s", 1), ("u2", "<p>two</p>", "s", 1)], SCHEMA).write.parquet(land)
    ingest(read_landing(spark, land, SCHEMA), store, f"file://{tmp_path}/check").awaitTermination()
    assert {r.url: r.action for r in store.current().collect()} == {"u1": "inserted", "u2": "inserted"}
    postings = postings_delta(store.changed())
    spark.createDataFrame([("u1", "<p>one</p>", "s", 5), ("u2", "<p>new</p>", "s", 5)], SCHEMA).write.mode("append").parquet(land)
    ingest(read_landing(spark, land, SCHEMA), store, f"file://{tmp_path}/check").awaitTermination()
    assert {r.url: (r.action, r.crawl_date) for r in store.current().collect()} == {"u1": ("dated", 5), "u2": ("replaced", 5)}
    after = apply_delta(postings, store.changed())
    assert sorted(map(tuple, after.select("url", "term").collect())) == [("u1", "one"), ("u2", "new")]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("u", "x", "s", 1, "h")], SCHEMA + ", content_hash string")
    store.apply(rows, 0)
    store.apply(spark.createDataFrame([("u", "y", "s", 2, "k")], SCHEMA + ", content_hash string"), 0)
    assert store.current().first().html_content == "x"


def test_stream_aggregates(spark, tmp_path):
    land = f"file://{tmp_path}/land"
    spark.createDataFrame([("u1", "<title>T</title>aa aa", "s", 7200), ("u2", "aa", "s", 7300)], SCHEMA).write.parquet(land)
    for name, make in (("tokens_q", token_counts), ("hours_q", pages_per_hour)):
        q = make(read_landing(spark, land, SCHEMA)).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("tokens_q").where("token = 'aa'").first().cnt == 3
    assert spark.table("hours_q").first().pages == 2
    assert titles(read_landing(spark, land, SCHEMA)).isStreaming


FULL = SCHEMA + ", content_hash string"


def files(root):
    return {str(p.relative_to(root)) for p in root.rglob("*.parquet")}


def test_a_batch_rewrites_only_the_parts_it_touches(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", parts=8)
    store.apply(spark.createDataFrame([(f"u{i}", "x", "s", 1, "h") for i in range(40)], FULL), 0)
    before = files(tmp_path)
    store.apply(spark.createDataFrame([("u3", "y", "s", 2, "k"), (None, "z", "s", 2, "k")], FULL), 1)
    assert before < files(tmp_path) and len({f for f in files(tmp_path) - before}) == 1
    pointer = store._pointer()
    assert sum(f.startswith("v1-") for f in pointer["folders"].values()) == 1
    got = {r.url: (r.action, r.html_content) for r in store.current().collect()}
    assert len(got) == 40 and got["u3"] == ("replaced", "y") and {a for a, _ in got.values()} == {"kept", "replaced"}
    store.apply(spark.createDataFrame([], FULL), 2)
    assert {r.action for r in store.current().collect()} == {"kept"} and store.current().count() == 40


def test_a_store_that_cannot_be_read_raises(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", parts=2)
    assert store.current().count() == 0  # there is none yet
    store.apply(spark.createDataFrame([("u", "x", "s", 1, "h")], FULL), 0)
    for f in (tmp_path / "s" / "pointers").glob("*.json"):
        f.write_text("{broken")
    for f in (tmp_path / "s" / "pointers").glob(".*.crc"):
        f.unlink()
    for call in (store.current, lambda: store.apply(spark.createDataFrame([("v", "x", "s", 1, "h")], FULL), 1)):
        with pytest.raises(Exception, match="."):
            call()
    assert len(files(tmp_path)) == 1


def test_a_failed_batch_leaves_no_trace(spark, tmp_path):
    from pyspark.sql import functions as F

    store = Store(spark, f"file://{tmp_path}/s", parts=2)
    store.apply(spark.createDataFrame([("u", "x", "s", 1, "h")], FULL), 0)
    bad = spark.createDataFrame([("u", "y", "s", 2, "k")], FULL).withColumn("html_content", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        store.apply(bad, 1)
    assert store.current().first().html_content == "x"
    store.apply(spark.createDataFrame([("u", "y", "s", 2, "k")], FULL), 1)
    assert store.current().first().html_content == "y"
