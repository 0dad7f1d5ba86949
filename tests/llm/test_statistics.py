import math
import random
from collections import Counter

import pyarrow as pa

from lyrebird.llm.distinctive import global_weights, local_frequencies, log_entropy, telling_words
from lyrebird.llm.frequencies import MAPS, RECORD, TERMS, RadixSpill, differing_counts, fold_term, latest_stats, marked, partial_sums, term_frequencies


def test_radix_spill(tmp_path):
    rng = random.Random(8)
    rows = [("t", f"w{rng.randrange(700)}", rng.randrange(1, 5)) for _ in range(20_000)]
    hashes = {w: rng.randrange(-(2**63), 2**63) for _, w, _ in rows}
    batches = [
        pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[(k, w, hashes[w], n, 1) for k, w, n in rows[i : i + 3000]]), TERMS)], schema=TERMS)
        for i in range(0, len(rows), 3000)
    ]
    got = {(r["kind"], r["term"]): (r["total"], r["records"]) for b in RadixSpill(str(tmp_path), split_rows=300).run(iter(batches)) for r in b.to_pylist()}
    total, records = Counter(), Counter()
    for k, w, n in rows:
        total[k, w] += n
        records[k, w] += 1
    assert got == {k: (total[k], records[k]) for k in total}


def test_radix_spill_of_one_hash(tmp_path):
    batch = pa.RecordBatch.from_arrays([pa.array(["t"] * 50), pa.array(["same"] * 50), pa.array([7] * 50), pa.array([1] * 50), pa.array([1] * 50)], schema=TERMS)
    got = [r for b in RadixSpill(str(tmp_path / "a"), split_rows=10).run(iter([batch])) for r in b.to_pylist()]
    assert [(r["term"], r["total"]) for r in got] == [("same", 50)]
    assert list(RadixSpill(str(tmp_path / "b")).run(iter([]))) == []


STATS = "stats_id bigint, computed_at timestamp_ntz, total_documents bigint, total_bytes bigint, total_tokens bigint, unique_tokens bigint, unique_stems bigint, token_freq map<string,bigint>, stem_freq map<string,bigint>"


def stats(spark):
    from datetime import datetime as d

    rows = [
        (1, d(2024, 1, 1), 1, 1, 1, 1, 1, {"old": 5}, {"old": 5}),
        (1, d(2024, 1, 2), 1, 1, 1, 1, 1, {"Кот": 2, " кот": 3, "zero": 0, "none": None}, {"кот": 5}),
        (1, d(2024, 1, 2), 1, 1, 1, 1, 1, {"Кот": 2, " кот": 3, "zero": 0, "none": None}, {"кот": 5}),
        (2, d(2024, 1, 1), None, 1, 1, 1, 1, {"кот": 1, "ёж": 4}, None),
        (3, None, 0, 1, 1, 1, 1, None, None),
        (None, d(2024, 1, 1), 0, 1, 1, 1, 1, {"lost": 1}, None),
    ]
    return spark.createDataFrame(rows, STATS)


def test_frequencies(spark):
    sums = partial_sums(latest_stats(stats(spark)), "stats_id", MAPS)
    rows = marked(term_frequencies(sums), sums.where(f"kind = '{RECORD}token'")).collect()
    assert {(r.kind, r.term): (r.total, r.records, r.rare, r.common) for r in rows} == {
        ("token", "кот"): (6, 2, False, True), ("token", "ёж"): (4, 1, True, False), ("stem", "кот"): (5, 1, True, False),
    }
    index = spark.createDataFrame([(1, 1), (2, 3), (3, 0), (3, None), (9, 4)], "stats_id bigint, unique_terms bigint")
    assert [r.stats_id for r in differing_counts(index, sums).collect()] == [2]


def test_frequencies_of_nothing(spark):
    sums = partial_sums(latest_stats(stats(spark).limit(0)), "stats_id", MAPS)
    assert term_frequencies(sums).count() == 0 and sums.count() == 0


def test_frequencies_with_spilling(spark):
    """The same sums whether they fit a task's memory or are spilled level by level."""
    rows = [(i, {f"t{(i * k) % 97}": k for k in range(1, 40)}) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, m map<string,bigint>")
    got = [{tuple(r) for r in term_frequencies(partial_sums(df, "id", {"x": "m"}, split_rows=n), split_rows=n).collect()} for n in (10, 500_000)]
    want = {("x", f"t{t}", sum(k for i in range(200) for k2, k in rows[i][1].items() if k2 == f"t{t}"), sum(f"t{t}" in m for _, m in rows)) for t in range(97)}
    assert got[0] == got[1] == want


def test_folding():
    assert fold_term(" \u00a0Ёж\n") == "ёж" and fold_term("İ") == "İ"


DOCS = [(1, "аа аа бб"), (2, "аа вв"), (3, "аа бб бб бб"), (4, None), (5, "")]


def test_log_entropy(spark):
    df = spark.createDataFrame(DOCS, "doc_id bigint, text string").selectExpr("*", "1 as term", "2 as tf")
    tf = {(i, w): n for i, t in DOCS if t for w, n in Counter(t.split()).items()}
    got = {(r.doc_id, r.term): r.score for r in log_entropy(df).collect()}
    for (i, w), n in tf.items():
        ps = [x / sum(v for (_, u), v in tf.items() if u == w) for (_, u), x in tf.items() if u == w]
        weight = 1 + sum(p * math.log(p) for p in ps) / math.log(len(DOCS))
        assert math.isclose(got[i, w], math.log(1 + n) * weight, abs_tol=1e-9)
    assert len(got) == len(tf)


def test_repeated_ids_add_up(spark):
    df = spark.createDataFrame([(1, "аа бб"), (1, "аа аа"), (2, "бб"), (None, "бб"), (3, "аа " * 50_000)], "doc_id bigint, text string")
    got = {(r.doc_id, r.term): r.tf for r in local_frequencies(df).collect()}
    assert got == {(1, "аа"): 3, (1, "бб"): 1, (2, "бб"): 1, (3, "аа"): 50_000}


def test_the_weight_decides(spark):
    """The executed plan holds the logarithms, and the score takes out what the counts would let in were it wrong."""
    rows = [(i, "слово " * 5 + f"своё{'абвгдежзик'[i]}") for i in range(8)] + [(20, "редкое " * 5), (21, "редкое " * 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    wanted = df.select("doc_id")
    plan = telling_words(df, wanted)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "log1p" in plan and "weight" in plan
    assert {(r.doc_id, r.term) for r in telling_words(df, wanted, most_df=99).collect()} == {(i, "слово") for i in range(8)} | {(20, "редкое"), (21, "редкое")}
    # a limit on the weight of two documents leaves no room for a term of eight, whatever the count says
    by_score = telling_words(df, wanted, least_df=2, most_df=2)
    assert {r.term for r in by_score.collect()} == {"редкое"} and all(r.weight >= 1 - math.log(2) / math.log(10) - 1e-9 for r in by_score.collect())
    both = [{tuple(r) for r in telling_words(df, wanted, by_weight=w).select("doc_id", "term").collect()} for w in (True, False)]
    assert both[0] == both[1]  # nothing within the limits is lost


def test_telling_words(spark):
    df = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    wanted = spark.createDataFrame([(3,), (3,), (9,), (None,)], "doc_id bigint")
    assert [(r.doc_id, r.term) for r in telling_words(df, wanted, 3, 2, 6).collect()] == [(3, "бб")]
    assert log_entropy(df.limit(0)).count() == 0
    one = df.where("doc_id = 1")
    assert all(r.weight == 1.0 for r in global_weights(local_frequencies(one), one).collect())
