import hashlib

from lyrebird.llm.blocks import best_containers, main_blocks, mark_chrome, parse, score_tree, words
from lyrebird.llm.pages import candidate_blocks, main_bodies, repeated_lines, site_of

LONG = "Оркестр играл, хор пел, и публика, как всегда, долго не расходилась после концерта."


def texts(html):
    return [b.text for b in parse(html).blocks]


def test_words():
    assert words("Ёлка É \u0130stanbul \u212a1x a bb") == ["ёлка", "stanbul", "1x", "bb"]


def test_blocks():
    assert texts("<p>one <b>two</b>three</p>four") == ["one twothree", "four"]
    assert texts("<head><title>x</title></head>a1<!-- no > no -->b2<script>c3</script><STYLE>d4</style>e5") == ["a1", "b2", "e5"]
    assert texts("<p>aa &amp;lt; &eacute;&#8230;</p><p>—</p><p> </p>") == ["aa &lt; é…", "—"]
    assert texts("") == [] and texts("<") == [] and texts("<p") == []


def test_broken_markup():
    page = parse("<ul><li>aa<li>bb</ul><P>cc<P>dd<pre><code>ee</code></pre></div></div><table><tr><td>ff<td>gg</table>")
    assert [b.text for b in page.blocks] == ["aa", "bb", "cc", "dd", "ee", "ff", "gg"]
    assert [b.pre for b in page.blocks] == [False] * 4 + [True] + [False] * 2
    assert len(parse("<div>" * 5000 + "aa" + "</p>" * 5000).blocks) == 1


def page(article, chrome="Все права защищены"):
    return f"<body><ul><li><a href=/a>Главная</a><li><a href=/b>Новости</a></ul><div class=art>{article}</div><p>© 2020 Сайт</p><p>{chrome}</p></body>"


def test_main_blocks():
    html = page(f"<h1>Имя</h1><p>{LONG}</p><div class=share>Поделиться</div><form><p>Подписаться на рассылку</p></form><p>{LONG} Ещё.</p><p>Читайте также: <a href=x>совсем другое имя</a></p>")
    assert [b.text for b in main_blocks(parse(html))] == ["Имя", LONG, LONG + " Ещё."]
    assert main_blocks(parse("<ul><li><a href=/a>Меню</a></ul>")) == [] and main_blocks(parse("")) == []


def test_scores():
    p = parse(page(f"<p>{LONG}</p>" * 3))
    score = score_tree(p, mark_chrome(p)[1])
    assert p.hints[best_containers(p, score)[0]] == "art"


def test_site_of():
    assert site_of("HTTP://u@www.Host.example:80/p?q") == "host.example" and site_of(None) == "" and site_of("x") == ""


NOTE = "Наш сайт рассказывает о музыке и о людях, которые её играют каждый день."


def crawl(spark):
    pages = []
    for i in range(8):
        own = " ".join(f"слово{'абвгдежз'[i]}{'клмнопрстуфх'[k]} играет," for k in range(12))
        pages.append((i, f"http://a.example/{i}", page(f"<h1>Лист {'абвгдежз'[i]} имя</h1><p>{own}</p><p>{NOTE}</p><p>{own[::-1]} {LONG}</p>")))
    same = page(f"<h1>Общая</h1><p>{LONG}</p><p>{LONG} Второй раз то же самое.</p>")
    pages += [(20 + i, f"http://b.example/{i}", same) for i in range(6)]
    pages += [(40, None, None), (41, "http://b.example/", ""), (42, "x", "<p>no</p>")]
    return spark.createDataFrame(pages, "page_id bigint, url string, html_content string")


def test_notes_of_a_site(spark):
    df = crawl(spark).withColumnRenamed("url", "url")
    bodies = {r.page_id: [b.words for b in r.blocks] for r in main_bodies(df).collect()}
    note = " ".join(words(NOTE))
    assert set(bodies) == {*range(8), *range(20, 26)}
    assert not any(note in b for b in bodies.values())
    assert all(" ".join(words(LONG)) in bodies[i] for i in range(20, 26))  # copies of one article keep their paragraphs
    assert {r.site for r in repeated_lines(candidate_blocks(df)).collect()} == {candidate_blocks(df).where("page_id = 1").first().site}


def test_lines_known_by_counts(spark):
    own = lambda i: " ".join(f"слово{'абвгдежз'[i]}{'клмнопрстуфх'[k]} играет," for k in range(12))
    pages = [(i, f"http://{'ab'[i % 2]}.example/{i}", page(f"<h1>Лист {'абвгдежз'[i]} имя</h1><div>Просмотров: {i}51</div><h2>Биография</h2><p>{own(i)}</p><div>Поделиться</div><p>{own(i)[::-1]} {LONG}</p>")) for i in range(8)]
    bodies = {r.page_id: [b.words for b in r.blocks] for r in main_bodies(spark.createDataFrame(pages, "page_id bigint, url string, html_content string")).collect()}
    assert len(bodies) == 8 and all("биография" in b and "поделиться" not in b and not any("просмотров" in x for x in b) for b in bodies.values())


GREEK, CHINESE = "Η ορχήστρα έπαιξε χθες το βράδυ, και το κοινό, όπως πάντα, έμεινε ώρα πολλή.", "交響樂團昨晚在大廳演出，觀眾久久不願離去，指揮多次謝幕，大家都說這是最好的一晚。"


def test_other_scripts(spark):
    for text in (GREEK, CHINESE):
        got = [b.text for b in main_blocks(parse(page(f"<h1>{text[:4]}</h1><p>{text}</p><p>{text}{text[::-1]}</p><p>→ ♪ ←</p>")))]
        assert got == [text[:4], text, text + text[::-1], "→ ♪ ←"]
    df = spark.createDataFrame([(1, "x", page(f"<h1>1</h1><p>{GREEK}</p><p>{CHINESE}</p>"))], "page_id bigint, url string, html_content string")
    assert [b.text for b in main_bodies(df, with_text=True).first().blocks] == ["1", GREEK, CHINESE]


def test_one_site_of_all_pages_and_one_line_in_all(spark):
    """No array of a site's lines, and no window or task of one site or line: only partial sums and joins by line."""
    df = crawl(spark)
    lines = repeated_lines(candidate_blocks(df))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in lines and "Window" not in lines


def test_keys_and_clashing_columns(spark):
    df = crawl(spark).selectExpr("*", "1 as blocks", "2 as site", "3 as notes").where("page_id = 20")
    got = main_bodies(df).first().blocks
    assert got[0].key == hashlib.md5("общая".encode()).hexdigest()[:16]


def test_empty_table(spark):
    assert main_bodies(crawl(spark).limit(0)).count() == 0
