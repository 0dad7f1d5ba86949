import random
from fractions import Fraction

import pytest

from lyrebird.llm.neardup import Collection, counted_tokens, id_pairs, near_duplicates, representatives, shingles, similar_classes, url_paths, url_words, word_hashes


def test_url_words():
    assert url_words("HTTP://h.example/A%20b/Ёлка-1/?q=no#no") == "1 a b ёлка"
    assert url_words("/only/path.html") == "html only path" and url_words(None) is None and url_words("http://h") == ""
    assert url_words("http://h/%D0%90%zz") == "zz а"


def brute(sets, t):
    ids = sorted(sets)
    out = set()
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common * t.denominator >= len(sets[a] | sets[b]) * t.numerator and common:
                out.add((a, b))
    return out


@pytest.mark.parametrize(("t", "seed"), [(Fraction(3, 5), 1), (Fraction(3, 4), 2), (Fraction(4, 5), 3)])
def test_against_brute_force(spark, t, seed):
    rng = random.Random(seed)
    sets = {}
    for f in range(25):
        base = [rng.randrange(400) for _ in range(rng.randrange(3, 40))]
        for _ in range(rng.randrange(1, 5)):
            own = {x if rng.random() > 0.12 else rng.randrange(1000) for x in base} | set(range(-rng.randrange(3), 0))
            sets[len(sets)] = own
    df = spark.createDataFrame([(i, [*s]) for i, s in sets.items()], "cls bigint, tokens array<bigint>")
    assert {tuple(r) for r in similar_classes(df, t).collect()} == brute(sets, t)
    assert {tuple(r) for r in similar_classes(df, t, every=1).collect()} == brute(sets, t)  # many tokens counted as hot ones


def test_a_token_in_every_set(spark):
    """Its rows are dealt by set, so that no task gets them all."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    sets = {i: {7, *(rng.randrange(50 + i % 3) + 1000 * (i % 40) for _ in range(12))} for i in range(400)}
    df = spark.createDataFrame([(i, [*s]) for i, s in sets.items()], "cls bigint, tokens array<bigint>")
    counted = counted_tokens(df.withColumn("n", F.size("tokens")), every=4)
    assert {r.cls for r in counted.collect() if r.token == 7} == set(sets)
    window = counted._jdf.queryExecution().optimizedPlan().toString()
    assert window.count("Window [") == 1 and "xxhash64(token" in window
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if they were large
    placed = counted.where("token = 7").groupBy(F.spark_partition_id().alias("p")).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(placed) > 1 and max(r["count"] for r in placed) < 200
    assert {tuple(r) for r in similar_classes(df, Fraction(3, 5), every=4).collect()} == brute(sets, Fraction(3, 5))


def test_collections_with_thresholds_of_their_own(spark):
    """Two in one pass give what each gives alone; equal texts and tokens of different collections aren't compared."""
    rng = random.Random(12)
    texts = [(i, " ".join(sorted({f"w{rng.randrange(14)}" for _ in range(9)}))) for i in range(60)]
    df = spark.createDataFrame(texts, "id bigint, text string")
    parts = [Collection(df, word_hashes, Fraction(3, 5)), Collection(df.where("id < 40"), word_hashes, Fraction(3, 4))]
    both = {tuple(r) for r in id_pairs(*near_duplicates(parts)).collect()}
    alone = {(f, *tuple(r)[1:]) for f, p in enumerate(parts) for r in id_pairs(*near_duplicates([p])).collect()}
    sets = {i: set(t.split()) for i, t in texts}
    assert both == alone == {(0, *p) for p in brute(sets, Fraction(3, 5))} | {(1, *p) for p in brute({i: s for i, s in sets.items() if i < 40}, Fraction(3, 4))}


def test_representatives(spark):
    a, b, c = "a b c d e f g h", "a b c d e f g x", "q r s t u v w y"
    rows = [(5, a), (2, a), (3, b), (4, c)]
    of, links = representatives(*near_duplicates([Collection(spark.createDataFrame(rows, "id bigint, text string"), word_hashes, Fraction(3, 4))]))
    assert {tuple(r) for r in of.collect()} == {(0, 5, 2), (0, 2, 2), (0, 3, 3), (0, 4, 4)} and [tuple(r) for r in links.collect()] == [(0, 2, 3)]


def test_copies_nulls_and_repeats(spark):
    a, b, c = "a b c d e f g h", "a b c d e f g x", "q r s t u v w y"
    rows = [(1, a), (2, a), (2, a), (3, b), (4, c), (5, None), (6, c)] + [(i, a) for i in range(100, 130)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = {tuple(r)[1:] for r in id_pairs(*near_duplicates([Collection(df, word_hashes, Fraction(3, 4))])).collect()}
    same = [1, 2, *range(100, 130)]
    want = {(x, y) for x in same for y in same if x < y} | {tuple(sorted((x, 3))) for x in same} | {(4, 6)}
    assert got == want


def test_shingles(spark):
    df = spark.createDataFrame([(1, "a b c a b c"), (2, "a b"), (3, "a b c")], "cls bigint, text string")
    got = {r.cls: set(r.tokens) for r in shingles(3)(df).collect()}
    assert len(got[1]) == 3 and got[2] == set() and got[3] <= got[1]


def test_urls(spark):
    rows = [(1, "http://a/one/two/three/four/five/six/seven"), (2, "https://b/one-two-three-four-five-six-eight"), (3, "http://a/one/two"), (4, None), (5, "http://c/one/two"), (1, "http://a/one/two/three/four/five/six/seven")]
    df = spark.createDataFrame(rows, "doc_id bigint, url string").selectExpr("*", "0 as id", "1 as text")
    assert [tuple(r) for r in id_pairs(*near_duplicates([url_paths(df)])).collect()] == [(0, 1, 2)]
    assert id_pairs(*near_duplicates([url_paths(df.limit(0))])).count() == 0
