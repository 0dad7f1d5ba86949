import io
import json
import threading
import urllib.request

import pytest

from lyrebird.__main__ import main
from lyrebird.operators.index import build
from lyrebird.sources.fetch import ascii_url, fetch_pages, outcome
from lyrebird.sources.server import answer, serve


def test_fetch(spark):
    wanted = spark.createDataFrame([("http://h/a", "s", 0), ("http://h/b", "s", 0), ("http://g/c", "s", 1), ("http://g/gone", None, 1)], "url string, source_name string, depth int")

    def get(url):
        return {"http://h/a": (200, "<p>a</p>"), "http://h/b": (503, None), "http://g/c": (200, "c")}.get(url, (404, None))

    rows = {r.url: (r.status, r.html_content) for r in fetch_pages(wanted, get, hosts_at_once=2, sleep=lambda s: None).collect()}
    assert rows == {"http://h/a": (200, "<p>a</p>"), "http://h/b": (503, None), "http://g/c": (200, "c"), "http://g/gone": (404, None)}


def test_every_host_has_its_own_clock(spark, tmp_path):
    """Two requests to one host are at least its delay apart, over batches and retries; other hosts don't wait for it."""
    log = tmp_path / "log"
    wanted = spark.createDataFrame([(f"http://{h}/{i}", "s", 0, d) for h, d in (("a", 9.0), ("b", None)) for i in range(3)], "url string, source_name string, depth int, delay double")

    class Time:
        def __init__(self):
            self.now = 0.0

        def clock(self):
            return self.now

        def sleep(self, s):
            self.now += s

    time_ = Time()

    def get(url):
        with open(log, "a") as f:
            f.write(f"{time_.now} {url}\n")
        return (503, None) if url == "http://b/1" else (200, "x")

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    fetch_pages(wanted, get, hosts_at_once=1, sleep=time_.sleep, clock=time_.clock).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    at = {}
    for line in log.read_text().splitlines():
        when, url = line.split()
        at.setdefault(url.split("/")[2], []).append(float(when))
    gaps = {h: [b - a for a, b in zip(t, t[1:])] for h, t in at.items()}
    assert len(at["a"]) == 3 and len(at["b"]) == 5 and min(gaps["a"]) >= 9 and min(gaps["b"]) >= 5
    assert at["b"][0] == at["a"][-1]  # no wait between hosts


def test_robots_files(spark):
    from lyrebird.sources.fetch import fetch_robots, robots_delay

    hosts = spark.createDataFrame([("http", "h"), ("https", "h"), ("http", "none")], "scheme string, domain string")
    text = "User-agent: *\nCrawl-delay: 8"
    got = {r.domain: (r.robots_txt, r.delay) for r in fetch_robots(hosts, lambda u: (200, text) if u == "http://h/robots.txt" else (404, None)).collect()}
    assert got == {"h": (text, 8.0), "none": (None, None)} and robots_delay("") is None


def test_outcomes():
    assert [outcome(s, 1, 3) for s in (200, 429, 404, 500, 302, None)] == ["ok", "retry", "fail", "retry", "ok", "retry"]
    assert outcome(429, 3, 3) == "fail"
    assert ascii_url("http://h/Бах?q=1") == "http://h/%D0%91%D0%B0%D1%85?q=1" and ascii_url("http://h/a") == "http://h/a"


@pytest.fixture(scope="module")
def index(spark):
    return build(spark.createDataFrame([(i, f"http://h/{i}", f"<title>T{i} \"</title>red w{i}") for i in range(3)], "page_id bigint, url string, html_content string"))


def test_answers(index):
    status, kind, body = answer(index, "/api/search?q=red+!w0&limit=1&page=2")
    assert status == 200 and kind.startswith("application/json")
    got = json.loads(body)
    assert got["total"] == 2 and got["results"] == [{"title": 'T2 "', "url": "http://h/2"}]
    assert json.loads(answer(index, "/api/search?q=red&page=0&limit=x")[2])["results"] == []
    assert "T0" in answer(index, "/search?q=red")[2] and answer(index, "/nothing")[0] == 404 and answer(index, "/")[0] == 200


def test_server(index):
    server = serve(index, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/api/search?q=w1") as r:
        assert json.load(r)["total"] == 1
    server.shutdown()


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    spark.createDataFrame([("http://h/1", "<title>One</title>red"), ("http://h/2", "")], "url string, html_content string").write.parquet(f"{tmp_path}/p")
    assert main(["index", f"{tmp_path}/p", f"{tmp_path}/i"]) == 0
    assert main(["search", f"{tmp_path}/i", "-q", "red", "--stats"]) == 0
    assert main(["stats", f"{tmp_path}/p", "--test", "--output", f"{tmp_path}/o"]) == 0
    out = capsys.readouterr().out
    assert "red: 1" in out and "pages tokenised" in out and "tokens/s" in out
    assert {"statistics.txt", "ranks", "ranks.gp"} == {x.name for x in (tmp_path / "o").iterdir()}
    monkeypatch.setattr("sys.stdin", io.StringIO("red\n\nnothing\n"))
    assert main(["search", f"{tmp_path}/i", "-i"]) == 0
    out = capsys.readouterr().out
    assert out.count(">>> ") == 4 and "red: 1" in out and "nothing: 0" in out


def test_crawl_command(spark, tmp_path, monkeypatch, capsys):
    from lyrebird import fixtures
    from lyrebird.operators import waves
    from lyrebird.streaming.ingest import Store

    real = waves.crawl
    monkeypatch.setattr(waves, "crawl", lambda *a, **k: real(*a, **{**k, "get": fixtures.web, "sleep": lambda s: None}))
    (tmp_path / "config.json").write_text(json.dumps({"logic": {"sources": [{"name": "h", "url": "http://h/s"}], "max_depth": 3, "max_pages": 3}}))
    assert main(["crawl", f"{tmp_path}/config.json", f"file://{tmp_path}/store"]) == 0
    assert "asked 3" in capsys.readouterr().out.splitlines()[-1]
    store = Store(spark, f"file://{tmp_path}/store")
    assert {r.url for r in store.current().collect()} == {"http://h/s", "http://h/a", "http://h/b"}
    # a second run goes on with the links of what is stored, and asks for nothing again
    asked = []
    monkeypatch.setattr(waves, "crawl", lambda *a, **k: real(*a, **{**k, "get": fixtures.web, "sleep": lambda s: None, "report": asked.append}))
    (tmp_path / "config.json").write_text(json.dumps({"logic": {"sources": [{"name": "h", "url": "http://h/s"}], "max_depth": 3, "max_pages": 0}}))
    assert main(["crawl", f"{tmp_path}/config.json", f"file://{tmp_path}/store"]) == 0
    assert {r.url for r in store.current().collect()} == {f"http://h/{x}" for x in "sabcde"}


def test_pages_of_results():
    from lyrebird.sources.reports import result_page, start_page

    row = [{"title": "<T>", "url": "http://h/?a&b"}]
    middle = result_page("a && b", 120, row, 2, 3)
    assert "&lt;T&gt;" in middle and "q=a+%26%26+b&amp;page=1" in middle and "page=3" in middle and "Page 2 of 3" in middle
    assert "Previous" not in result_page("a", 1, row, 1, 1) and "Nothing found" in result_page("a", 0, [], 1, 1) and "||" in start_page()
