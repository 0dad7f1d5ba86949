import random

import pytest

from lyrebird.llm.encoding import PAIRS, fit, garble, garbled, sample_texts, shown, ungarble

random.seed(7)
STEMS = "концерт оркестр музык рояль скрипк публик город театр голос мелоди сцен пев учени хор опер".split()
ENDS = ["", "а", "ами", "ы", "ов", "ом", "у", "ный", "ная", "ого"]
FRENCH = "élève théâtre célèbre après première récital où à était né joué naquit musique œuvre français".split()
GERMAN = "für Größe Bühne spät übte schön Straße gegründet hörte Künstler und der das Konzert Stück".split()


def russian(n, rng=random):
    out = []
    for i in range(n):
        w = rng.choice(STEMS) + rng.choice(ENDS)
        out.append(w.capitalize() if i % 9 == 0 else rng.choice(["и", "в", "на", "с", "не"]) if i % 4 == 3 else w)
    return " ".join(out) + "."


def western(n, words, rng=random):
    return " ".join(rng.choice(words) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return fit([russian(120, rng) for _ in range(150)] + [western(100, w, rng) for w in (FRENCH, GERMAN) for _ in range(30)])


@pytest.mark.parametrize(("wrong", "right"), [p for p in PAIRS if p[1] not in ("cp1252",)])
def test_inverse(wrong, right):
    own = {"cp1253": "Συναυλία για βιολί", "shift_jis": "音楽が好き", "euc_jp": "音楽が好き", "gb18030": "他喜欢音乐", "big5": "他喜歡音樂", "euc_kr": "음악을 좋아해서"}
    text = own.get(right, "Концерт для скрипки")
    assert ungarble(garble(text, wrong, right), wrong, right) == text


@pytest.mark.parametrize("pair", [("cp1251", "utf-8"), ("cp1252", "utf-8"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1252", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1251", "utf-8 utf-8"), ("mac-roman", "utf-8")])
def test_held_out_accuracy(model, pair):
    rng = random.Random(hash(pair) % 1000)
    clean = [f"<p>{russian(25, rng)}</p>" for _ in range(20)]
    bad = [f"<p>{russian(6, rng)} {garble(russian(12, rng), *pair)} {russian(6, rng)}</p>" for _ in range(20)]
    assert sum(bool(s and model.restore(t, s)[1]) for t, s in zip(clean, model.spans(clean))) <= 1
    assert sum(bool(s and model.restore(t, s)[1]) for t, s in zip(bad, model.spans(bad))) >= 18


def test_restores(model):
    text = russian(30, random.Random(4))
    broken = garble(text, "cp1251", "utf-8")
    assert model.restore(broken, model.spans([broken])[0])[0] == text


def test_clean_look_alikes_of_garbling(model):
    fine = ["РСФСР, СССР и РС в списке", "СРЕДИ ОРКЕСТРОВ ЕСТЬ СКРИПКИ", western(20, FRENCH), western(20, GERMAN), "plain", ""]
    for t, s in zip(fine, model.spans(fine)):
        assert not (s and model.restore(t, s)[1]), t


def test_entities():
    assert shown("&eacute;&#1072;&lt;b&gt;&amp;&nbsp;&unknown;") == "éа&lt;b&gt;&amp;&nbsp;&unknown;"


def test_operator(spark, model):
    bad = garble(russian(20, random.Random(5)), "koi8-r", "cp1251")
    rows = [(1, bad), (1, bad), (2, russian(20)), (3, None), (4, ""), (5, "\ufffd\ufffd потеряно"), (6, "x" * 300_000), (7, russian(3000) + bad)]
    df = spark.createDataFrame(rows, "id bigint, text string").selectExpr("*", "1 as spans")
    got = garbled(df, model).collect()
    assert sorted(r.id for r in got) == [1, 1, 5, 7]
    assert next(r for r in got if r.id == 5).turned == 0
    assert garbled(df.limit(0), model).count() == 0


def test_sample(spark):
    df = spark.createDataFrame([(f"text {i}",) for i in range(50)] + [(None,), ("",)], "text string")
    a, b = sample_texts(df, size=10), sample_texts(df.repartition(5), size=10)
    assert a == b and len(a) == 10 and sample_texts(df.limit(0)) == []


def test_the_inverse_of_the_label_is_reported(model):
    """The pair named is the one whose inverse gives the text that stands there."""
    rng = random.Random(21)
    for pair in [("cp1251", "utf-8"), ("koi8-r", "cp1251"), ("cp1252", "cp1251"), ("cp866", "cp1251"), ("cp1252", "utf-8"), ("mac-roman", "utf-8")]:
        for _ in range(5):
            text = russian(20, rng)
            bad = garble(text, *pair)
            new, good = model.restore(bad, model.spans([bad])[0])
            assert new == text and {model.pairs[k] for _, _, k in good} == {pair}


def test_lost_characters_are_a_state(model):
    from lyrebird.llm.encoding import GONE

    rng = random.Random(22)
    text = f"{russian(10, rng)} пот\ufffd\ufffdря {russian(10, rng)}"
    spans = model.spans([text])[0]
    assert [(text[a:z], model.pairs[k]) for a, z, k in spans] == [("\ufffd\ufffd", GONE)] and model.restore(text, spans) == (text, [])
    bad = garble(russian(12, rng), "cp1251", "utf-8")
    both = bad[:40] + "\ufffd" + bad[40:]
    found = {model.pairs[k] for _, _, k in model.spans([both])[0]}
    assert found == {GONE, ("cp1251", "utf-8")} and {model.pairs[k] for _, _, k in model.restore(both, model.spans([both])[0])[1]} == {("cp1251", "utf-8")}


HELD_OUT = {
    "cp1253": ["Ο συνθέτης έγραψε την πρώτη του συμφωνία σε ηλικία είκοσι ετών.", "Το βιβλίο κυκλοφόρησε μετά τον πόλεμο και αγαπήθηκε από όλους."],
    "shift_jis": ["彼は若い頃から音楽が好きで、毎日ギターを弾いていた。", "この映画は去年の夏に公開されました。"],
    "euc_jp": ["彼は若い頃から音楽が好きで、毎日ギターを弾いていた。", "この映画は去年の夏に公開されました。"],
}
FOUND = {
    "big5": ["他從小喜歡音樂，每天都彈吉他。", "這部電影是去年夏天上映的。"],
    "gb18030": ["他从小喜欢音乐，每天都弹吉他。", "这部电影是去年夏天上映的。"],
    "euc_kr": ["그는 어릴 때부터 음악을 좋아해서 매일 기타를 쳤다.", "이 영화는 작년 여름에 개봉했다."],
}


def test_held_out_sentences_of_other_languages(model):
    """Sentences that aren't in the known text: all garbled ones are found, those of the first table restored letter by letter,
    and the clean ones stay."""
    for right, texts in (HELD_OUT | FOUND).items():
        for text in texts:
            bad = f"<p>{garble(text, 'cp1252', right)}"
            spans = model.spans([bad])[0]
            new, good = model.restore(bad, spans)
            assert good or model.sure(bad, spans, good), text
            clean = model.spans([text])[0]
            assert not model.restore(text, clean)[1] and not model.sure(text, clean, []), text
            if right in HELD_OUT:
                assert new == f"<p>{text}" and {model.pairs[k] for _, _, k in good} == {("cp1252", right)}


def test_model_is_bounded():
    from lyrebird.llm.encoding import MOST_CHARS, GarbleModel

    many = "".join(chr(0x4E00 + i) * 3 for i in range(3000))
    assert GarbleModel([many], PAIRS[:2]).n <= MOST_CHARS + 20


@pytest.mark.parametrize("pair", [("cp1251", "utf-8"), ("cp1252", "utf-8"), ("cp1252", "cp1251"), ("koi8-r", "cp1251")])
def test_a_third_garbled_by_one_pair(pair):
    rng = random.Random(11)
    texts = [russian(60, rng) for _ in range(90)] + [western(60, w, rng) for w in (FRENCH, GERMAN) for _ in range(15)]
    model = fit([garble(t, *pair) if k % 3 == 0 else t for k, t in enumerate(texts)])
    bad = [garble(russian(4, rng), *pair) for _ in range(40)]
    fine = [russian(25, rng) for _ in range(40)] + [western(25, w, rng) for w in (FRENCH, GERMAN) for _ in range(20)]
    found = [[bool(s and model.restore(t, s)[1]) for t, s in zip(x, model.spans(x))] for x in (bad, fine)]
    assert sum(found[0]) >= 38 and sum(found[1]) <= 1


def test_stretches_that_cannot_be_turned_back(spark, model):
    rng = random.Random(13)
    kept = random.Random(14)
    bad = ["".join(c for c in garble(russian(20, rng), "cp1251", "utf-8") if ord(c) < 128 or kept.random() < 0.4) for _ in range(20)]
    fine = [russian(20, rng) for _ in range(20)] + [russian(20, rng).upper() for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(bad + fine)), "id bigint, text string")
    got = {r.id: r for r in garbled(df, model).collect()}
    assert sum(i in got for i in range(20)) >= 19 and not any(i in got for i in range(20, 60))
    assert any(r.spans > r.turned for r in got.values())


def test_sample_reads_texts_to_their_end(spark):
    from lyrebird.llm.encoding import SAMPLE_CHARS, clean_sample

    texts = ["д" * 20_000 + "<p>ő", "м" * (2 * SAMPLE_CHARS) + "<p>ű"]
    got = sample_texts(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert sorted(t[-1] for t in clean_sample(got)) == ["ő", "ű"] and max(map(len, got)) <= SAMPLE_CHARS + 10


def test_titles_are_sampled(spark, tmp_path, monkeypatch):
    from lyrebird.llm import encoding

    spark.createDataFrame([(1, "страница")], "page_id bigint, html_content string").write.parquet(f"{tmp_path}/crawled.parquet")
    spark.createDataFrame([(1, "заглавие")], "doc_id bigint, title string").write.parquet(f"{tmp_path}/docinfo.parquet")
    seen = []
    monkeypatch.setattr(encoding, "fit", lambda texts: seen.extend(texts) or fit(texts))
    assert encoding.p2_found(spark, str(tmp_path)).count() == 0 and sorted(seen) == ["заглавие", "страница"]


def test_all_texts_are_fitted_on(spark, tmp_path, monkeypatch):
    """Of 900 pages and 900 titles, and of a long page, nothing is left out of the model."""
    from lyrebird.llm import encoding

    rng = random.Random(31)
    pages = [f"<p>{russian(5, rng)} {i}</p>" for i in range(899)] + ["д" * 70_000 + "ű" + "м" * 70_000]
    titles = [f"{western(3, FRENCH, rng)} {i}" for i in range(900)]
    spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html_content string").write.parquet(f"{tmp_path}/crawled.parquet")
    spark.createDataFrame(list(enumerate(titles)), "doc_id bigint, title string").write.parquet(f"{tmp_path}/docinfo.parquet")
    seen = []
    monkeypatch.setattr(encoding, "fit", lambda texts: seen.extend(texts) or fit(texts))
    assert encoding.p2_found(spark, str(tmp_path)).count() == 0 and sorted(seen) == sorted(pages + titles)


def test_tasks_count_as_one_list(spark, model):
    from lyrebird.llm.encoding import Texts, clean_statistics

    rng = random.Random(32)
    texts = [f"<p>{russian(30, rng)} — «{western(5, FRENCH, rng)}»" for _ in range(60)] + [garble(russian(30, rng), "cp1251", "utf-8") for _ in range(20)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "t string").repartition(7)
    got, want = Texts((df, "t"), (df.limit(0), "t")).clean_statistics(model), clean_statistics(texts, model)
    assert dict(zip(got.pairs.tolist(), got.times.tolist())) == dict(zip(want.pairs.tolist(), want.times.tolist()))
    more = {w: n for w, n in zip(want.words.tolist(), want.uses.tolist()) if n > 1}
    assert more and dict(zip(got.words.tolist(), got.uses.tolist())) == more
    none = Texts((df.limit(0), "t")).clean_statistics(model)
    assert len(none.pairs) == len(none.words) == 0


@pytest.mark.parametrize("pair", [("cp1252", "utf-8"), ("koi8-r", "utf-8"), ("cp1251", "utf-8 utf-8"), ("cp1252", "gb18030"), ("koi8-r", "cp1251")])
def test_counts_of_garbled_text_follow_from_those_of_the_text(pair):
    """The pairs counted once and turned by each character's image are those of the garbled texts themselves."""
    import numpy as np

    from lyrebird.llm.encoding import AFTER, KINDS, SHIFT, _Images, statistics

    rng = random.Random(33)
    texts = [f"{russian(20, rng)} — «А»! 12 {western(9, FRENCH if pair[1] != 'cp1251' else ['der', 'Xylophon'], rng)} {russian(4, rng)}" for _ in range(9)]
    stats = statistics(texts)
    model, first, second = fit(texts), stats.pairs >> SHIFT, stats.pairs & ((1 << SHIFT) - 1)
    letter = first % KINDS < AFTER, second % KINDS < AFTER
    first, second = (x // KINDS * AFTER + x % AFTER for x in (first, second))
    units = np.union1d([0], np.concatenate([first, second]))
    a, b = np.searchsorted(units, first), np.searchsorted(units, second)
    once = np.bincount(b[letter[1]], stats.times[letter[1]], len(units))
    got = _Images(units, pair).pairs(model.cls, model.n, a, b, letter, stats.times, once)
    want = sum(np.bincount(model._codes(garble(t, *pair)), minlength=model.n**2) for t in texts)
    assert (got.reshape(-1) == want).all()


def test_spans_side_by_side_and_garbled_twice(model):
    """Garbled twice as Latin-1: control characters stand for those of cp1252, and no part of such a stretch is left."""
    text = "für didos’s, Verließ spätes Konzert, Größe Straße gegründet hörte — Übung café"
    bad = text
    for _ in range(2):
        bad = bad.encode().decode("latin-1")
    bad = f"<p>der Stück {bad} und</p>"
    assert model.restore(bad, model.spans([bad])[0])[0] == f"<p>der Stück {text} und</p>"


def test_what_repeats_is_judged_once(model, monkeypatch):
    """A menu that stands on many pages is decoded and turned back once, with the same spans and text on each page."""
    from lyrebird.llm.encoding import GarbleModel

    rng = random.Random(41)
    menu = garble(russian(12, rng), "cp1251", "utf-8")
    texts = [f"<p>page {'x' * i}</p> {menu} <p>{'y' * i} end</p>" for i in range(30)]
    decoded, tried = [], []
    viterbi, inverse = GarbleModel._viterbi, GarbleModel._turned
    monkeypatch.setattr(GarbleModel, "_viterbi", lambda self, todo, *more: decoded.extend(todo) or viterbi(self, todo, *more))
    monkeypatch.setattr(GarbleModel, "_turned", lambda self, *span: tried.append(span) or inverse(self, *span))
    monkeypatch.setattr(model, "tried", {})
    spans = model.spans(texts)
    alone = [model.spans([t])[0] for t in texts]
    assert spans == alone and all(spans) and len(decoded) == 1 + len(texts)
    texts = [f"<p>page {'x' * 12} {word} </p>" for word in [garble("скрипка", "cp1251", "utf-8")] * 30]
    spans = model.spans(texts)
    got = [model.restore(t, s)[0] for t, s in zip(texts, spans)]
    assert got == [f"<p>page {'x' * 12} скрипка </p>"] * 30 and 1 <= len(tried) == len(set(tried))


def test_likelihood_of_short_and_long_texts(model):
    """The loop over a short text gives what the arrays give."""
    from lyrebird.llm.encoding import SHORT

    rng = random.Random(42)
    for text in ["", "!", " — «А»! 12", "Ærø 音楽 Σ�\x85", russian(8, rng), western(8, FRENCH, rng), garble(russian(6, rng), "cp1251", "utf-8")]:
        assert len(text) <= SHORT and model.likelihood(text) == pytest.approx(float(model.clean[model._codes(text)].sum(dtype=float)) if text else 0.0, abs=1e-9)


def test_paths_are_those_of_every_choice(model):
    """The labels of short texts are those of the best of all paths, which enter, stay and leave at every place."""
    import numpy as np

    from lyrebird.llm.encoding import ENTER, LEAVE

    rng = random.Random(43)
    for pair in [("cp1251", "utf-8"), ("cp1252", "cp1251"), ("koi8-r", "cp1251")]:
        text = f"{russian(3, rng)} {garble(russian(2, rng), *pair)} {russian(3, rng)} {garble(russian(2, rng), *pair)}"
        odds = model.odds[:, model._codes(text)].astype(float)
        clean, inside = 0.0, np.full(len(odds), -1e9)
        for t in range(len(text)):
            clean, inside = max(clean, inside.max() - LEAVE), np.maximum(inside, clean - ENTER) + odds[:, t]
        got = -sum(ENTER + LEAVE * (z < len(text)) for _, z, _ in model.spans([text])[0])
        got += sum(odds[k, a:z].sum() for a, z, k in model.spans([text])[0])
        assert got == pytest.approx(max(clean, inside.max()), abs=0.01) and got > 0
