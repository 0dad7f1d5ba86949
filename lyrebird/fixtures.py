"""Small fixed cases with the results that are known for them, run as queries beside their VALUES."""

from __future__ import annotations

#: (url, file, article, closed) by the rules for files, articles and closed paths.
URLS = [
    ("https://ru.wikipedia.org/wiki/Бах", False, True, False),
    ("https://ru.wikipedia.org/wiki/%D0%91%D0%B0%D1%85", False, True, False),
    ("https://en.wikipedia.org/wiki/Bach", False, True, False),
    ("https://en.wikipedia.org/wiki/Q1", False, True, False),
    ("https://ru.wikipedia.org/wiki/Q1", False, False, True),
    ("https://ru.wikipedia.org/wiki/Pink", False, False, True),
    ("https://ru.wikipedia.org/wiki/d:Q5", False, False, True),
    ("https://de.wikipedia.org/wiki/Pink", False, True, False),
    ("https://ru.wikipedia.org/", False, False, False),
    ("https://ru.wikipedia.org/about", False, False, False),
    ("https://ru.wikipedia.org/w/index.php", False, False, True),
    ("https://ru.wikipedia.org/w/load.php?x=1", False, False, False),
    ("https://ru.wikipedia.org/w/load.php", False, False, True),
    ("https://ru.wikipedia.org/w/api.php?action=mobileview&a=1", False, False, False),
    ("https://ru.wikipedia.org/w/api.php?action=query", False, False, True),
    ("https://en.wikipedia.org/w/rest.php/site/v1/sitemap", False, False, False),
    ("https://en.wikipedia.org/api/rest_v1/page", False, False, True),
    ("https://en.wikipedia.org/api/rest_v1/?doc", False, False, False),
    ("https://en.wikipedia.org/trap/x", False, False, True),
    ("https://en.wikipedia.org/wiki/Special:Search", False, False, True),
    ("https://en.wikipedia.org/wiki/Special%3ASearch", False, False, True),
    ("https://en.wikipedia.org/wiki/Special%253ASearch", False, False, True),
    ("https://de.wikipedia.org/wiki/Spezial:Suche", False, False, True),
    ("https://no.wikipedia.org/wiki/Spesial:S", False, False, True),
    ("https://en.wikipedia.org/wiki/User:A", False, False, False),
    ("https://en.wikipedia.org/wiki/User_talk:A", False, False, False),
    ("https://en.wikipedia.org/wiki/User%3AA", False, False, False),
    ("https://en.wikipedia.org/wiki/Category:Music", False, False, False),
    ("https://en.wikipedia.org/wiki/Category%3AMusic", False, False, False),
    ("https://en.wikipedia.org/wiki/Wikipedia:About", False, False, False),
    ("https://en.wikipedia.org/wiki/File:A", True, False, False),
    ("https://ru.wikipedia.org/wiki/Файл:А", True, False, False),
    ("https://en.wikipedia.org/wiki/Media:A", True, False, False),
    ("https://ru.wikipedia.org/wiki/Медиа:А", True, False, False),
    ("https://en.wikipedia.org/wiki/A.jpg", True, False, False),
    ("https://ru.wikipedia.org/wiki/Категория:Музыка", False, False, False),
    ("https://ru.wikipedia.org/wiki/Категория%3AМузыка", False, False, False),
    ("https://ru.wikipedia.org/wiki/%D0%9A%D0%B0%D1%82%D0%B5%D0%B3%D0%BE%D1%80%D0%B8%D1%8F:100%", False, False, False),
    ("https://ru.wikipedia.org/wiki/Участник:А", False, False, True),
    ("https://ru.wikipedia.org/wiki/Участник%3AА", False, False, True),
    ("https://ru.wikipedia.org/wiki/%D0%A3%D1%87%D0%B0%D1%81%D1%82%D0%BD%D0%B8%D0%BA:100%", False, False, True),
    ("https://ru.wikipedia.org/wiki/%D0%A3%D1%87%D0%B0%D1%81%D1%82%D0%BD%D0%B8%D0%BA%3A%zz", False, False, True),
    ("https://en.wikipedia.org/wiki/Участник:А", False, False, False),
    ("https://ru.wikipedia.org/wiki/Участница:А", False, False, True),
    ("https://ru.wikipedia.org/wiki/Обсуждение_участника:А", False, False, True),
    ("https://ru.wikipedia.org/wiki/Обсуждение_участницы:А", False, False, True),
    ("https://ru.wikipedia.org/wiki/Википедия:О", False, False, True),
    ("https://ru.wikipedia.org/wiki/%D0%92%D0%B8%D0%BA%D0%B8%D0%BF%D0%B5%D0%B4%D0%B8%D1%8F:%D0%9E", False, False, True),
    ("https://ru.wikipedia.org/wiki/Википедия:Форум", False, False, True),
    ("https://ru.wikipedia.org/wiki/Википедия:А/wiki/Список:Б", False, False, False),
    ("https://ru.wikipedia.org/wiki/Википедия:Форум/wiki/Список:Б", False, False, True),
    ("https://ru.wikipedia.org/wiki/Викиновости:А", False, False, True),
    ("https://ru.wikipedia.org/wiki/Викицитатник:А", False, False, True),
    ("https://ru.wikipedia.org/wiki/%D0%92%D0%B8%D0%BA%D0%B8%D0%BD%D0%BE%D0%B2%D0%BE%D1%81%D1%82%D0%B8:A", False, False, True),
    ("https://ru.wikipedia.org/wiki/Служебная:Info", False, False, True),
    ("https://ru.wikipedia.org/wiki/Служебная:Other", False, True, False),
    ("https://ru.wikipedia.org/wiki/Специальная:Print", False, True, False),
    ("https://ru.wikipedia.org/wiki/Служебная:RecentChangesLinked/A", False, False, True),
    ("https://ru.wikipedia.org/wiki/Hawai%CA%BBi:A", False, False, True),
    ("https://ru.wikipedia.org/wiki/Hawaiʻi:A", False, True, False),
    ("https://ru.wikipedia.org/wiki/%D0%98%D1%80%D0%BE%D0%BD:A", False, False, True),
    ("https://ru.wikipedia.org/wiki/%D0%98%D1%80%D0%BE%D0%BD", False, True, False),
    ("http://music.example/wiki/Бах", False, False, False),
    ("http://music.example/w/", False, False, False),
    ("http://music.example/x.PNG?1", True, False, False),
    ("http://x.js.org/", True, False, False),
    ("http://music.example/File:x", True, False, False),
    ("http://music.example/file", False, False, False),
    ("not a url", False, False, False),
]

#: (text, decoded): escapes, whole, half and broken.
ESCAPES = [
    ("a%20b", "a b"), ("a+b", "a b"), ("a%2Bb", "a+b"), ("%D0%91%d0%b0%D1%85", "Бах"), ("100%", "100%"), ("100%4", "100%4"), ("%zz", "%zz"), ("%4 x", "\x04x"),
    ("%%41", "%A"), ("%4%41", "\x0441"), ("q=%26&r=%3D", "q=&&r=="), ("", ""), ("плюс+%21", "плюс !"), ("%", "%"), ("a%zzb%41", "a%zzbA"),
]

ROBOTS = "User-agent: *\nDisallow: /private/\nDisallow: /wiki/B\nAllow: /private/open\nCrawl-delay: 7\n\nUser-agent: other\nDisallow: /\n"
#: (url, whether robots are respected, allowed), where music.example and the encyclopedia's hosts have ROBOTS.
GATES = [
    ("http://music.example/", True, True), ("http://music.example/private/x", True, False), ("http://music.example/private/x", False, True),
    ("http://none.example/private/x", True, True), ("http://music.example/private", True, True), ("http://music.example/wiki/B", True, False),
    ("https://en.wikipedia.org/wiki/Bach", True, True), ("https://en.wikipedia.org/wiki/Special:B", True, False),
    ("https://en.wikipedia.org/wiki/Special:B", False, False), ("https://en.wikipedia.org/wiki/User:B", True, True),
    ("https://en.wikipedia.org/private/", True, False), ("https://ru.wikipedia.org/wiki/Q1", False, False),
]

#: (status, attempt, action, seconds before the next try) with three tries.
RESPONSES = [
    (200, 1, "ok", 5.0), (200, 3, "ok", 6.0), (301, 1, "ok", 5.0), (403, 1, "fail", 5.0), (404, 1, "fail", 5.0), (410, 2, "fail", 5.0), (429, 1, "retry", 5.0),
    (429, 2, "retry", 10.0), (429, 3, "fail", 15.0), (500, 1, "retry", 5.0), (503, 2, "retry", 5.0), (503, 3, "fail", 6.0), (None, 1, "retry", 5.0), (None, 3, "fail", 6.0),
]
#: (seconds that robots.txt asks for, configured seconds, seconds between requests)
DELAYS = [(None, 5.0, 5.0), (None, 2.0, 5.0), (None, 8.0, 8.0), (1.0, 8.0, 5.0), (7.0, 5.0, 7.0), (0.0, 5.0, 5.0)]

#: A small web: page, links. Of http://h the crawl starts at /s; /private is barred, /gone isn't there.
GRAPH = {
    "http://h/s": ["/a", "/b", "http://other/x", "/f.png", "/private/p", "/gone"],
    "http://h/a": ["/c"],
    "http://h/b": ["/c"],
    "http://h/c": ["/d"],
    "http://h/d": ["/e"],
    "http://h/e": ["/s"],
    "http://h/private/p": ["/e"],
}
#: What a crawl of it to depth 3 stores.
REACHED = ["http://h/s", "http://h/a", "http://h/b", "http://h/c", "http://h/d"]


def web(url: str) -> tuple[int, str | None]:
    """The small web's answer to a request."""
    if url == "http://h/robots.txt":
        return 200, ROBOTS
    links = GRAPH.get(url)
    return (404, None) if links is None else (200, "".join(f'<a href="{t}">t</a>' for t in links))


#: (query, its tree as text)
TREES = [
    ("a1 b1", "AND(a1, b1)"), ("a1 && b1 || c1", "OR(AND(a1, b1), c1)"), ("a1 || b1 && c1", "OR(a1, AND(b1, c1))"), ("!a1", "NOT(a1)"), ("!!a1", "NOT(NOT(a1))"),
    ("(a1 || b1) && !c1", "AND(OR(a1, b1), NOT(c1))"), ("a1", "a1"), ("a1 (b1 || c1)", "AND(a1, OR(b1, c1))"),
]
