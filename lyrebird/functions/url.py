"""URLs: normal form, tests and patterns."""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from urllib.parse import parse_qs, unquote, urlencode, urljoin, urlparse, urlunparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SLASHES = re.compile("/{2,}")


def normal_url(url: str | None, base: str | None = None) -> str:
    """A URL's normal form: resolved against ``base``, without fragment, path percent-decoded with single slashes and
    none at its end (but for the root), parameters sorted by name with their values together, scheme and host in lower
    case. '' for a null or empty URL and for one that can't be read."""
    if not url:
        return ""
    try:
        p = urlparse(urljoin(base, url) if base else url)
        path = _SLASHES.sub("/", unquote(p.path))
        if len(path) > 1:
            path = path.removesuffix("/")
        query = urlencode(sorted(parse_qs(p.query, keep_blank_values=True).items()), doseq=True)
        return urlunparse((p.scheme.lower(), p.netloc.lower(), path, p.params, query, ""))
    except ValueError:
        return ""


_known = lru_cache(200_000)(normal_url)
_ROOT = re.compile("[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*")


def resolved(url: str | None, base: str | None) -> str:
    """``normal_url`` of a link, remembered by what it depends on: a link from the root of its host, which most are, isn't
    read anew for each page of the host, nor an absolute one for each page."""
    if url and base:
        if url[0] == "/" and url[1:2] != "/":
            root = _ROOT.match(base)
            if root:
                return _known(url, root.group() + "/")
        elif url.startswith(("http://", "https://")):
            return _known(url, None)
    return normal_url(url, base)


@F.pandas_udf(T.StringType())
def normalize_url(url: pd.Series) -> pd.Series:
    """``normal_url`` of a column, in Arrow batches."""
    return url.map(normal_url)


@F.pandas_udf(T.StringType())
def resolve_url(url: pd.Series, base: pd.Series) -> pd.Series:
    """``normal_url`` of a column of links against the column of their pages."""
    return pd.Series([resolved(u, b) for u, b in zip(url, base)], dtype="object")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_valid(url: Column | str) -> Column:
    """Whether a URL has a scheme and a host."""
    return F.coalesce(_c(url).rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.lit(False))


def domain(url: Column | str) -> Column:
    """Host with user and port in lower case; '' if there is none."""
    return F.lower(F.regexp_extract(_c(url), "^[^:/?#]+://([^/?#]*)", 1))


def same_domain(a: Column | str, b: Column | str) -> Column:
    return domain(a) == domain(b)


#: Endings that mark files wherever they stand in a URL. Fixed values.
FILE_ENDINGS = (
    ".png .jpg .jpeg .gif .svg .webp .ico .pdf .doc .docx .xls .xlsx .ppt .pptx .zip .rar .7z .tar .gz .mp3 .mp4 .avi .mov "
    ".wmv .flv .css .js .json .xml .ttf .woff .woff2 .eot"
).split()
FILE_PATHS = "/File: /Файл: /wiki/Media: /wiki/Медиа:".split()


def _any(url: Column, parts: list[str]) -> Column:
    """Whether one of the parts stands in the URL. Many are one pattern, as many expressions are too much for one function."""
    if len(parts) > 3:
        return url.rlike("|".join(re.escape(p) for p in parts))
    return reduce(lambda a, b: a | b, (F.contains(url, F.lit(p)) for p in parts))


def is_file(url: Column | str) -> Column:
    """Whether a URL looks like one of a file."""
    return _any(F.lower(_c(url)), FILE_ENDINGS) | _any(_c(url), FILE_PATHS)


#: Paths of encyclopedia pages that aren't articles, held against the URL as it stands and decoded. Fixed values.
NO_ARTICLE = """
/wiki/Википедия:
/wiki/Wikipedia:
/wiki/Участник:
/wiki/Участница:
/wiki/Обсуждение_участника:
/wiki/Обсуждение_участницы:
/wiki/Special:
/wiki/User:
/wiki/User_talk:
/wiki/File:
/wiki/Файл:
/wiki/Media:
/wiki/Медиа:
/wiki/Category:
/wiki/Категория:
/wiki/Category%3A
/wiki/Категория%3A
/wiki/%D0%9A%D0%B0%D1%82%D0%B5%D0%B3%D0%BE%D1%80%D0%B8%D1%8F:
/wiki/%D0%9A%D0%B0%D1%82%D0%B5%D0%B3%D0%BE%D1%80%D0%B8%D1%8F%3A
""".split()
#: Paths that robots may not fetch on any of the encyclopedia's hosts. Fixed values.
CLOSED = """
/w/
/api/
/trap/
/wiki/Special:
/wiki/Spezial:
/wiki/Spesial:
/wiki/Special%3A
/wiki/Spezial%3A
/wiki/Spesial%3A
""".split()
#: What is allowed below two of them all the same. Fixed values.
CLOSED_BUT = {"/w/": ["/w/api.php?action=mobileview&", "/w/load.php?", "/w/rest.php/site/v1/sitemap"], "/api/": ["/api/rest_v1/?doc"]}
#: Paths that robots may not fetch on the Russian host. Fixed values.
CLOSED_RU = """
/wiki/Участник:
/wiki/Участник%3A
/wiki/%D0%A3%D1%87%D0%B0%D1%81%D1%82%D0%BD%D0%B8%D0%BA:
/wiki/%D0%A3%D1%87%D0%B0%D1%81%D1%82%D0%BD%D0%B8%D0%BA%3A
/wiki/Участница:
/wiki/Участница%3A
/wiki/%D0%A3%D1%87%D0%B0%D1%81%D1%82%D0%BD%D0%B8%D1%86%D0%B0:
/wiki/%D0%A3%D1%87%D0%B0%D1%81%D1%82%D0%BD%D0%B8%D1%86%D0%B0%3A
/wiki/Обсуждение_участника:
/wiki/Обсуждение_участника%3A
/wiki/%D0%9E%D0%B1%D1%81%D1%83%D0%B6%D0%B4%D0%B5%D0%BD%D0%B8%D0%B5_%D1%83%D1%87%D0%B0%D1%81%D1%82%D0%BD%D0%B8%D0%BA%D0%B0:
/wiki/%D0%9E%D0%B1%D1%81%D1%83%D0%B6%D0%B4%D0%B5%D0%BD%D0%B8%D0%B5_%D1%83%D1%87%D0%B0%D1%81%D1%82%D0%BD%D0%B8%D0%BA%D0%B0%3A
/wiki/Обсуждение_участницы:
/wiki/Обсуждение_участницы%3A
/wiki/%D0%9E%D0%B1%D1%81%D1%83%D0%B6%D0%B4%D0%B5%D0%BD%D0%B8%D0%B5_%D1%83%D1%87%D0%B0%D1%81%D1%82%D0%BD%D0%B8%D1%86%D1%8B:
/wiki/%D0%9E%D0%B1%D1%81%D1%83%D0%B6%D0%B4%D0%B5%D0%BD%D0%B8%D0%B5_%D1%83%D1%87%D0%B0%D1%81%D1%82%D0%BD%D0%B8%D1%86%D1%8B%3A
/wiki/Википедия:Выборы_арбитров/
/wiki/Википедия%3AВыборы_арбитров%2F
/wiki/Википедия:К_удалению
/wiki/Википедия%3AК_удалению
/wiki/Википедия:К_восстановлению
/wiki/Википедия%3AК_восстановлению
/wiki/Википедия:Архив_запросов_на_удаление/
/wiki/Википедия%3AАрхив_запросов_на_удаление%2F
/wiki/Википедия:Проверка_участников
/wiki/Википедия%3AПроверка_участников
/wiki/Википедия:Запросы_к_администраторам
/wiki/Википедия%3AЗапросы_к_администраторам
/wiki/Википедия:Заявки_на_снятие_флагов
/wiki/Википедия%3AЗаявки_на_снятие_флагов
/wiki/Википедия:Запросы,_связанные_с_VRTS
/wiki/Википедия%3AЗапросы%2C_связанные_с_VRTS
/wiki/%D0%92%D0%B8%D0%BA%D0%B8%D0%BF%D0%B5%D0%B4%D0%B8%D1%8F:
/wiki/Википедия:Сообщить_об_ошибке
/wiki/Википедия:Как_править_статьи
/wiki/Википедия:Сообщество
/wiki/Википедия:Форум
/wiki/Википедия:Справка
/wiki/Служебная:RecentChanges
/wiki/Специальная:NewPages
/wiki/Служебная:SpecialPages
/wiki/Служебная:WhatLinksHere
/wiki/Служебная:RecentChangesLinked
/wiki/Служебная:PermanentLink
/wiki/Служебная:Info
/wiki/Служебная:ShortUrl
/wiki/Специальная:QrCode
/wiki/Служебная:Print
/wiki/Специальная:DownloadAsPdf
/wiki/Специальная:PrintableVersion
/wiki/Викиновости:
/wiki/Викицитатник:
/wiki/%D0%92%D0%B8%D0%BA%D0%B8%D1%86%D0%B8%D1%82%D0%B0%D1%82%D0%BD%D0%B8%D0%BA:
/wiki/%D0%92%D0%B8%D0%BA%D0%B8%D0%BD%D0%BE%D0%B2%D0%BE%D1%81%D1%82%D0%B8:
/wiki/d:
/wiki/Q
/wiki/P
/wiki/%D0%90%D0%B7%C9%99%D1%80%D0%B1%D0%B0%D1%98%D1%81%D0%B0%D0%BD%D0%B4%D0%B6%D0%B0:
/wiki/%D0%91%D0%B0%D1%88%D2%A1%D0%BE%D1%80%D1%82%D1%81%D0%B0:
/wiki/%D0%91%D0%B5%D0%BB%D0%B0%D1%80%D1%83%D1%81%D0%BA%D0%B0%D1%8F:
/wiki/%D0%9D%D0%BE%D1%85%D1%87%D0%B8%D0%B9%D0%BD:
/wiki/%D0%A7%D3%90%D0%B2%D0%B0%D1%88%D0%BB%D0%B0:
/wiki/Hawai%CA%BBi:
/wiki/%D0%93%D0%B0%D0%B9%D0%B5%D1%80%D0%B5%D0%BD:
/wiki/%D0%9A%D1%8B%D1%80%D0%B3%D1%8B%D0%B7%D1%87%D0%B0:
/wiki/%D0%98%D1%80%D0%BE%D0%BD:
""".split()
#: Project pages of the Russian host are closed too, unless one of these is named as well. Fixed values.
PROJECT = "/wiki/Википедия:"
PROJECT_OPEN = ["/wiki/Категория:", "/wiki/Список:"]
ENCYCLOPEDIA = "wikipedia.org"


def _decoded(url: Column) -> Column:
    """Percent-decoded as far as it can be: a sign that begins no escape stays, as does a plus sign; bytes that aren't UTF-8
    become U+FFFD."""
    lenient = F.regexp_replace(F.replace(url, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(lenient), url)


def is_closed_path(url: Column | str) -> Column:
    """Whether a URL of the encyclopedia lies on a path that robots may not fetch."""
    u = _c(url)
    d = _decoded(u)

    def either(parts: list[str]) -> Column:
        return _any(u, parts) | _any(d, parts)

    general = either([path for path in CLOSED if path not in CLOSED_BUT])
    for path, but in CLOSED_BUT.items():
        general = general | (either([path]) & ~_any(u, but))
    russian = F.contains(domain(u), F.lit("ru." + ENCYCLOPEDIA)) & (either(CLOSED_RU) | (F.contains(d, F.lit(PROJECT)) & ~_any(d, PROJECT_OPEN)))
    return F.coalesce(F.contains(domain(u), F.lit(ENCYCLOPEDIA)) & (general | russian), F.lit(False))


def is_article(url: Column | str) -> Column:
    """Whether a URL is an article of the encyclopedia: no file, no closed path, no page of another kind."""
    u = _c(url)
    other = _any(u, NO_ARTICLE) | _any(_decoded(u), NO_ARTICLE)
    return F.coalesce(F.contains(domain(u), F.lit(ENCYCLOPEDIA)) & ~is_file(u) & ~is_closed_path(u) & F.contains(u, F.lit("/wiki/")) & ~other, F.lit(False))
