import os

import pytest

from lyrebird.llm.lookalikes import consistent_forms, dominant, key_of, mixed_tokens, plain, repair, same_look_pairs


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ｆｕｌｌ　１２", "full 12"), ("é", "é"), ("a\u200bb\u00adc\ufeff", "abc"), ("a\u00a0\u2009 b\n", "a b"), ("ﬁn Ⅳ", "fin IV"),
        ("K", "K"), ("a‑b‐c", "a-b-c"), ("👩\u200d🎤", "👩\u200d🎤"), ("x²", "x²"), ("—", "—"), ("", ""), (" ", ""), ("a…", "a..."),
    ],
)
def test_plain(text, want):
    assert plain(text) == want


def test_repair():
    assert repair("кoнцeрт") == "концерт" and repair("cоncert") == "concert" and repair("жz") is None
    assert [m["token"] for m in mixed_tokens("кoнцерт и concert")] == ["кoнцерт"]


def test_scripts():
    assert dominant("cop") is None and dominant("кoт") == "cyrillic" and dominant("cоncert") == "latin" and dominant("λόγoς") == "greek"
    assert repair("λόγoς") == "λόγος" and repair("сл\u03bfвам") == "словам" and repair("сoр") is None  # no letter says which
    assert key_of("сор кот") == "cop кот" and key_of("cop") == "cop" and key_of("жz о") == "жz o"


def test_repair_decides_the_pairs(spark):
    """Without the repair, texts whose words it would write in one script aren't found; tokens of look-alikes alone are."""
    df = spark.createDataFrame([(1, "концерт и хор"), (2, "кoнцеpт и xop"), (3, "о, а"), (4, "o, a"), (5, "нoвый"), (6, "новый")], "doc_id bigint, text string")
    on = {tuple(r) for r in same_look_pairs(consistent_forms(df)).collect()}
    off = {tuple(r) for r in same_look_pairs(consistent_forms(df, repaired=False)).collect()}
    assert on == {(1, 2), (3, 4), (5, 6)} and off == {(3, 4)}


def test_repair_decides_pairs_of_the_test_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    df = spark.read.parquet(path)
    on = {tuple(r) for r in same_look_pairs(consistent_forms(df)).collect()}
    off = {tuple(r) for r in same_look_pairs(consistent_forms(df, repaired=False)).collect()}
    assert off < on


def test_unsettled_on_both_sides(spark):
    assert pairs(spark, ["рoяль", "pояль"]) == {(0, 1)}  # the word itself occurs nowhere


def pairs(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 as form", "2 as look")
    return {tuple(r) for r in same_look_pairs(consistent_forms(df)).collect()}


def test_pairs(spark):
    texts = ["Концерт для хора", "Кoнцерт для хoра", "Концерт\u00a0для хора", "концерт для хора", "Концерт для хора!", None, "", " ", "\u00a0", "cop", "сор", "cöp", "Концерт для хора"]
    same = [0, 1, 2, 12]
    want = {(a, b) for a in same for b in same if a < b} - {(0, 12)} | {(9, 10)}
    assert pairs(spark, texts) == want


def test_visible_changes_stay(spark):
    assert pairs(spark, ["résumé 4", "resume 4", "résumé 1", "Résumé 4", "й", "и", "a-b", "a—b"]) == set()


def test_repair_needs_the_vocabulary(spark):
    df = spark.createDataFrame([(1, "кoнцерт"), (2, "концерт"), (3, "рoяль"), (4, None), (1, "кoнцерт")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.form) for r in consistent_forms(df).collect() if r.form)
    assert got == [(1, "концерт"), (1, "концерт"), (2, "концерт"), (3, "рoяль")]
    assert consistent_forms(df.limit(0)).count() == 0


def test_many_copies(spark):
    texts = ["кот и пёс"] * 300 + ["кoт и пёс"]
    assert len(pairs(spark, texts)) == 300
