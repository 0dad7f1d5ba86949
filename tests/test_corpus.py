import math

import pytest

from lyrebird.operators.corpus import corpus_stats, deviation, grid, mandelbrot, mandelbrot_fit, ranked, stem_frequencies, token_frequencies, top, zipf
from lyrebird.sources.reports import plot_script, result_page, write_rank_table, write_statistics


@pytest.fixture(scope="module")
def ranks(spark):
    return ranked(spark.createDataFrame([(f"w{i:04}", max(1, 3000 // (i + 2))) for i in range(1200)], "token string, cnt bigint"))


def test_grid():
    points = grid()
    assert len(points) == 14 * 20 and points[-1] == (1.4500000000000006, 4.800000000000002)


def test_ranks(ranks):
    rows = ranks.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 1201))
    assert all((a.cnt, b.term) >= (b.cnt, a.term) for a, b in zip(rows, rows[1:]))


def test_laws_keep_the_sum(ranks):
    n = ranks.groupBy().sum("cnt").first()[0]
    for law in (zipf(ranks), mandelbrot(ranks), zipf(ranks, 1.3)):
        assert math.isclose(law.groupBy().sum("theoretical").first()[0], n, rel_tol=1e-9)


def test_fit_against_brute_force(ranks):
    rows = ranks.orderBy("rank").collect()
    n, best = sum(r.cnt for r in rows), None
    for b, rho in grid():
        norm = sum((r["rank"] + rho) ** -b for r in rows)
        error = sum((math.log(r.cnt + 1) - math.log((r["rank"] + rho) ** -b / norm * n + 1)) ** 2 for r in rows[:1000]) / 1000
        if best is None or error < best[0]:
            best = (error, b, rho, rows[0].cnt * (1 + rho) ** b)
    got = mandelbrot_fit(ranks).first()
    assert math.isclose(got.error, best[0], rel_tol=1e-9) and (got.b, got.rho) == best[1:3] and math.isclose(got.p, best[3])


@pytest.mark.parametrize(("n", "zones"), [(5, 1), (150, 3), (1000, 3), (1200, 4)])
def test_zones(spark, n, zones):
    df = spark.createDataFrame([(i + 1, 10, 5.0) for i in range(n)], "rank bigint, cnt bigint, theoretical double")
    rows = deviation(df).orderBy("zone").collect()
    assert len(rows) == zones and all(r.pct == 100.0 and r.direction == "above" for r in rows)


def test_frequencies(spark):
    pages = spark.createDataFrame([("<p>Кот кота the 12 x1</p>",), ("",), (None,)], "html_content string")
    freq = token_frequencies(pages)
    assert {r.token: r.cnt for r in freq.collect()} == {"кот": 1, "кота": 1, "x1": 1}
    assert {r.stem: r.cnt for r in stem_frequencies(freq).collect()} == {"кот": 2, "x1": 1}
    row = corpus_stats(pages).first()
    assert (row.total_documents, row.total_tokens, row.unique_tokens, row.unique_stems, row.avg_token_length) == (3, 3, 3, 2, 3.0)
    assert [(r["rank"], r.token) for r in top(freq, 2).orderBy("rank").collect()] == [(1, "x1"), (2, "кот")]


def test_reports(spark, ranks, tmp_path):
    write_rank_table(ranks, f"file://{tmp_path}/r")
    lines = [x for f in sorted((tmp_path / "r").glob("part*")) for x in f.read_text().splitlines()]
    assert "# Rank\tFrequency\tTerm" in lines and "1\t1500\tw0000" in lines
    assert "zipf(x) = 7 / (1.78 * x)" in plot_script("d.tsv", "o.png", "t", 7, 1.0, 2.7, 3.0)
    freq = spark.createDataFrame([("a", 2)], "token string, cnt bigint")
    write_statistics(freq.groupBy().count(), top(freq, 1), str(tmp_path / "s.txt"))
    assert "1. a: 2" in (tmp_path / "s.txt").read_text()
    assert "&lt;" in result_page("<", 0, [], 1, 1)
