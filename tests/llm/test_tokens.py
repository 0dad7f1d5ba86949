import os
import random

import numpy as np
import pytest

from lyrebird.llm.packing import fill_figures, filled_containers, first_fit, measured, p8_filled, pack
from lyrebird.llm.tokens import SpeculativeBpe, token_ids, vocabulary_path

pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def bpe():
    return SpeculativeBpe(vocabulary_path())


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(vocabulary_path())
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_against_the_library(bpe, reference):
    rng = random.Random(2)
    letters = "abcdeё жзЖ\n\t 0123  aaaa's'tthequ日本👩‍🎤é"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["", " ", "a" * 20_000, "<|endoftext|>", "it's we'll", "  x", "\r\n\r\n", "1" * 500]
    assert bpe.encode(texts) == reference(texts)
    assert 0 < bpe.merged < bpe.guessed


def test_exact_and_guess(bpe, reference):
    words = ["unbelievable", "tokenization", "ёжиками", "aaaaab"]
    assert [bpe.exact(w.encode()) for w in words] == reference(words)
    assert bpe.words(words) == reference(words)


def test_pairs(bpe):
    rng = random.Random(4)
    by_id = {i: t for t, i in bpe.ids.items()}
    a, b = (np.array([rng.choice(list(by_id)) for _ in range(2000)]) for _ in range(2))
    want = [bpe.exact(by_id[x] + by_id[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert bpe.compatible(a, b).tolist() == want


def test_null_empty_and_repeats(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hi hi"), (3, "hi hi"), (None, "x")], "doc_id bigint, text string").selectExpr("*", "1 as ids")
    got = sorted((r.doc_id or 0, r.ids) for r in token_ids(df).collect())
    assert got == [(0, [87]), (1, []), (2, []), (3, [5303, 23105]), (3, [5303, 23105])]
    assert token_ids(df.limit(0)).count() == 0


def test_pack_obeys_all_limits():
    rng = np.random.default_rng(1)
    limits = np.array([100, 8, 60])
    demand = np.column_stack([rng.integers(1, 100, 500), np.ones(500, int), rng.integers(0, 60, 500)])
    number = pack(demand, limits)
    for k in range(number.max() + 1):
        assert (demand[number == k].sum(0) <= limits).all()
    lower = np.ceil((demand.sum(0) / limits).max())
    assert number.max() + 1 <= 1.15 * lower + 2
    assert len(pack(demand[:0], limits)) == 0


def test_containers(spark):
    rng = random.Random(6)
    sizes = [(i, n, rng.randrange(n + 1)) for i, n in enumerate([0, 0, 1, 100, 101, 1000] + [rng.randrange(1, 90) for _ in range(600)])]
    df = spark.createDataFrame(sizes, "doc_id bigint, tokens int, loss int").selectExpr("*", "1 as capacity", "'x' as container_kind")
    kinds = spark.createDataFrame([("s", 100), ("m", 400), ("none", None), ("zero", 0)], "container_kind string, capacity_tokens int")
    rows = filled_containers(df, kinds, group_rows=128).collect()
    assert sorted(r.doc_id for r in rows if r.container_id is None) == [0, 1]
    for kind, capacity in (("s", 100), ("m", 400)):
        own = [r for r in rows if r.container_kind == kind]
        filled, held, pieces = {}, {}, {}
        for r in own:
            filled[r.container_id] = filled.get(r.container_id, 0) + r.tokens
            held[r.doc_id] = held.get(r.doc_id, 0) + r.tokens
            pieces[r.doc_id] = pieces.get(r.doc_id, 0) + 1
        assert max(filled.values()) <= capacity
        assert held == {i: n for i, n, _ in sizes if n}
        assert all(pieces[i] == -(-n // capacity) for i, n, _ in sizes if n)
        assert sum(filled.values()) / capacity / len(filled) > 0.93
        assert sum(r.loss for r in own) <= sum(x for _, _, x in sizes)
    assert filled_containers(df.limit(0), kinds).count() == 0
    assert filled_containers(df, kinds.limit(0)).count() == 2


def test_measured(spark):
    df = spark.createDataFrame([(1, "hi\nhi hi"), (2, "hi hi"), (3, None), (4, "  ")], "doc_id bigint, text string")
    got = {r.doc_id: (r.tokens, r.loss) for r in measured(df).collect()}
    assert got[1] == (4, 3) and got[2] == (2, 2) and got[3] == (0, 0)


def test_loss_above_the_limit_is_reported(spark):
    sizes = spark.createDataFrame([(1, 100, 100), (2, 60, 30), (3, 40, 30), (4, 90, 85), (5, 10, 0), (6, 200, 0)], "doc_id bigint, tokens int, loss int")
    kinds = spark.createDataFrame([("a", 100)], "container_kind string, capacity_tokens int")
    rows = filled_containers(sizes, kinds, loss_slack=1.25).collect()
    assert {r.loss_limit for r in rows} == {62}  # 245 of 500 tokens
    assert {(r.doc_id, r.piece): r.loss for r in rows} == {(1, 0): 100, (2, 0): 30, (3, 0): 30, (4, 0): 85, (5, 0): 0, (6, 0): 0, (6, 1): 0}
    assert {r.doc_id for r in rows if r.over_limit} == {1, 4}
    held = {}
    for r in rows:
        held.setdefault(r.container_id, []).append(r)
    for own in held.values():
        assert sum(r.tokens for r in own) <= 100 and len(own) <= own[0].segments
        over = [r for r in own if r.over_limit]
        assert sum(r.loss for r in own) <= 62 or (len(over) == 1 and not any(r.loss for r in own if not r.over_limit))


def _cases(seed):
    rng = np.random.default_rng(seed)
    tokens = np.concatenate([rng.integers(1, 60, 700), rng.integers(60, 500, 700)])
    rng.shuffle(tokens)
    loss = (tokens * rng.uniform(0.3, 1.0, len(tokens))).astype(int)
    return np.column_stack([tokens, np.ones_like(tokens), loss])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_dimensions_decide(seed):
    """Packing by tokens alone breaks the limits on segments and loss; the dot product over all of them keeps them, and needs
    fewer containers than the dot product over tokens and than first fit."""
    demand = _cases(seed)
    total = demand.sum(0)
    limits = np.array([512, int(512 * total[1] / total[0] * 1.3), int(512 * total[2] / total[0] * 1.15)])
    demand[:, 2] = np.minimum(demand[:, 2], limits[2])
    alone = pack(demand[:, :1], limits[:1])
    broken = [(demand[alone == k].sum(0) > limits).any() for k in range(alone.max() + 1)]
    assert np.mean(broken) > 0.1
    whole, tokens_only = pack(demand, limits), pack(demand, limits, dimensions=1)
    assert (whole != tokens_only).any() and (whole != alone).any()
    for k in range(whole.max() + 1):
        assert (demand[whole == k].sum(0) <= limits).all()
    assert whole.max() <= tokens_only.max() and whole.max() <= first_fit(demand, limits).max()


def test_limits_bind_on_the_test_documents(spark):
    path = "/root/testdata/sf0.01"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    rows = p8_filled(spark, path).where("container_id is not null").collect()
    for kind in {r.container_kind for r in rows}:
        own = [r for r in rows if r.container_kind == kind]
        limits = np.array([own[0].capacity, own[0].segments, own[0].loss_limit])
        own = [r for r in own if not r.over_limit]
        demand = np.array([(r.tokens, 1, r.loss) for r in sorted(own, key=lambda r: (r.doc_id, r.piece))])
        alone, whole = pack(demand[:, :1], limits[:1]), pack(demand, limits)
        assert any((demand[alone == k].sum(0) > limits).any() for k in range(alone.max() + 1)) and (alone != whole).any()
    figures = {r.container_kind: r for r in fill_figures(p8_filled(spark, path)).collect()}
    assert all(r.most_segments <= r.segments and r.most_loss <= r.loss_limit and r.fill > 0.9 for r in figures.values())


def test_counts_are_those_of_the_ids(bpe):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab c\nёж 12's\r\n") for _ in range(rng.randrange(40))) for _ in range(500)] + ["", None, "\n\n", "q\n", " q\nz"]
    got = bpe.counts(texts)
    assert [n for n, _ in got] == [len(x) for x in bpe.encode(texts)] and all(0 <= p <= n for n, p in got)
    assert got[-1][1] > 0 and got[-2][1] == 0
