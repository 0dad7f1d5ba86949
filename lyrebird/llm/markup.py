"""Markup left in the text of articles (problem 6): minimum-cut labelling of blocks, then conversion of what is left."""

from __future__ import annotations

import html as _html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.blocks import DIGITS, HEADINGS, Block, Page, main_blocks, mark_chrome, parse, weight_of
from lyrebird.plans.spread import spread

# ------------------------------------------------------------------------------------------------- minimum cut

#: What the classifier looks at, of a block and of the elements around it. None of it is the verdict of problem 5.
FEATURES = (
    "bias", "length", "long", "link", "commas", "sentence", "digits", "heading", "item", "cell", "paragraph", "pre", "marked", "early", "late",
    "parent_share", "parent_link", "parent_texts", "above_share", "above_link", "above_mean", "after_h1", "in_list", "in_table", "in_body",
    "before", "after", "parent_longest", "above_longest", "linked_item", "named", "runs_on",
    "parent_prose", "parent_prose_share", "above_prose", "above_prose_share", "alone",
)
#: Pages on which the classifier is fitted, chosen by the hash of their html; longer ones than so many characters aren't.
SAMPLE, SAMPLE_CHARS = 1500, 100_000
#: Weight of the prior, strength of its pull in the fit, steps of the fit, and the bound of one block's log odds.
PRIOR = {"bias": -1.5, "length": 2.0, "link": -4.0, "sentence": 1.0, "paragraph": 1.0, "heading": 0.5, "marked": -3.0, "parent_share": 2.0}
PULL, STEPS, MOST = 1.0, 12, 6.0
#: Log odds by which content is preferred: text that is lost costs more than a line too many.
KEEP = 1.0
#: Capacities that the fit chooses from: between neighbours in document order, and between texts of one element.
CAPACITIES = ((0.0, 0.0), (0.5, 0.5), (1.0, 1.0), (2.0, 1.0), (1.0, 2.0), (2.0, 2.0), (3.0, 3.0), (2.0, 4.0), (4.0, 4.0))


def min_cut(prefer: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labels of least cost: a node against its preference costs its absolute value (positive: true), and an edge
    whose ends differ costs its capacity.

    A node whose preference is at least the sum of its edges keeps it in some optimum; it is fixed and its edges become
    preferences of its neighbours, as long as there is such a node. What is left is solved by maximum flow along
    shortest augmenting paths: preferences are the capacities to the terminals, and a node is true if the source still
    reaches it."""
    size = len(prefer)
    want = list(prefer)
    near: list[dict[int, float]] = [{} for _ in range(size)]
    for a, b, c in edges:
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
    label: list[bool | None] = [None] * size
    queue = deque(range(size))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(want[i]) >= sum(near[i].values()):
            label[i] = want[i] > 0
            for j, c in near[i].items():
                want[j] += c if label[i] else -c
                del near[j][i]
                queue.append(j)
            near[i] = {}
    left = [i for i in range(size) if label[i] is None]
    if left:
        source, sink = size, size + 1
        room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in left}
        room[source], room[sink] = {}, {}
        for i in left:
            if want[i] > 0:
                room[source][i] = want[i]
                room[i].setdefault(source, 0.0)
            else:
                room[i][sink] = -want[i]
                room[sink].setdefault(i, 0.0)
        while True:
            came = {source: source}
            queue = deque([source])
            while queue and sink not in came:
                i = queue.popleft()
                for j, c in room[i].items():
                    if c > 1e-12 and j not in came:
                        came[j] = i
                        queue.append(j)
            if sink not in came:
                break
            path, j = [], sink
            while j != source:
                path.append((came[j], j))
                j = came[j]
            flow = min(room[a][b] for a, b in path)
            for a, b in path:
                room[a][b] -= flow
                room[b][a] = room[b].get(a, 0.0) + flow
        for i in left:
            label[i] = i in came
    return [bool(x) for x in label]


SENTENCE = re.compile(r"[.!?…。！？;:][»”“\"')\]]*$")
_PARAGRAPH = frozenset("p blockquote figcaption caption".split())


def features(page: Page) -> np.ndarray:
    """The blocks' rows of ``FEATURES``."""
    tags, parents, blocks = page.tags, page.parents, page.blocks
    size = len(tags)
    chars, links, texts, most, prose = [0] * size, [0] * size, [0] * size, [0] * size, [0] * size
    for b in blocks:
        length = len(b.text)
        chars[b.node] += length
        most[b.node] = max(most[b.node], length)
        links[b.node] += min(b.link, length)
        texts[b.node] += 1
        prose[b.node] += length > 80 and 2 * b.link < length
    for n in range(size - 1, 0, -1):
        prose[parents[n]] += prose[n]
        chars[parents[n]] += chars[n]
        links[parents[n]] += links[n]
        texts[parents[n]] += texts[n]
        most[parents[n]] = max(most[parents[n]], most[n])
    first = next((i for i, b in enumerate(blocks) if tags[b.node] == "h1"), len(blocks))
    logs = [0.0, *(min(1.0, math.log1p(len(b.text)) / 5) for b in blocks), 0.0]
    whole, last = max(chars[0], 1), max(len(blocks) - 1, 1)
    marked = mark_chrome(page)[1]
    out = []
    for i, b in enumerate(blocks):
        tag, text = tags[b.node], b.text
        length, commas = weight_of(text)
        up = max(parents[b.node], 0)
        above = max(parents[up], 0)
        out.append((
            1.0, min(1.0, math.log1p(length) / 5), length > 150, min(b.link, len(text)) / len(text), min(4, commas) / 4, SENTENCE.search(text) is not None,
            DIGITS.search(text) is not None, tag in HEADINGS, tag in ("li", "dt", "dd"), tag in ("td", "th"), tag in _PARAGRAPH, b.pre, marked[i],
            max(0.0, 1 - 8 * i / last), max(0.0, 4 * i / last - 3), chars[up] / whole, links[up] / max(chars[up], 1), min(texts[up], 20) / 20,
            chars[above] / whole, links[above] / max(chars[above], 1), min(chars[above] / max(texts[above], 1), 200) / 200,
            i >= first, tags[up] in ("ul", "ol", "dl"), tags[up] in ("tr", "table", "tbody"), tags[up] in ("body", "html", "#root"),
            logs[i], logs[i + 2], min(most[up], 300) / 300, min(most[above], 300) / 300, tag == "li" and 2 * b.link > len(b.text), page.hints[up] != "",
            i > 0 and tags[blocks[i - 1].node] == tag,
            min(prose[up], 5) / 5, prose[up] / max(prose[0], 1), min(prose[above], 5) / 5, prose[above] / max(prose[0], 1), texts[up] == 1,
        ))
    return np.array(out, np.float64).reshape(len(blocks), len(FEATURES))


def edges_of(page: Page, adjacent: float, same: float) -> list[tuple[int, int, float]]:
    """Smoothness between neighbours in document order, less the farther apart they stand in the tree, and between each text
    of an element's children and the next."""
    parents, blocks = page.parents, page.blocks
    out, last = [], {}
    for i, block in enumerate(blocks):
        up = parents[block.node]
        if i:
            before = blocks[i - 1].node
            near = before == block.node or parents[before] == up
            close = near or before == up or parents[before] == block.node
            out.append((i - 1, i, adjacent * (1.0 if near else 0.5 if close else 0.15)))
        if up in last:
            out.append((last[up], i, same))
        last[up] = i
    return out


@dataclass
class ContentModel:
    """Weights of the classifier and capacities of the edges."""

    weights: np.ndarray
    adjacent: float
    same: float

    def prefer(self, page: Page) -> list[float]:
        """Each block's log odds of being content: its capacity to the source, or, negative, to the sink."""
        return np.clip(features(page) @ self.weights + KEEP, -MOST, MOST).tolist()

    def labels(self, page: Page, smooth: bool = True) -> list[bool]:
        """The labels of the minimum cut; not ``smooth``: those of the classifier alone."""
        prefer = self.prefer(page)
        return min_cut(prefer, edges_of(page, self.adjacent, self.same)) if smooth else [x > 0 for x in prefer]


def fit_weights(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, drawn to ``PRIOR``, so that few rows change it little."""
    prior = np.array([PRIOR.get(f, 0.0) for f in FEATURES])

    def loss(w: np.ndarray) -> float:
        x = rows @ w
        return float(np.logaddexp(0, x).sum() - x @ labels + PULL / 2 * ((w - prior) ** 2).sum())

    w = prior.copy()
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        grad = rows.T @ (p - labels) + PULL * (w - prior)
        hess = (rows * (p * (1 - p))[:, None]).T @ rows + PULL * np.eye(len(w))
        step, now = np.linalg.solve(hess, grad), loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_content(htmls: list[str]) -> ContentModel:
    """Trains itself on sample pages: the blocks that tree scoring puts into main bodies are taken as content; from these
    labels, which hold errors, the weights of the block's own signs are learned, and then, on the half of the pages that the
    weights weren't fitted on, the capacities with which the cut errs least. No page is judged by its own labels: where signs,
    neighbours and tree disagree with the scoring, they win."""
    pages = [p for p in map(parse, htmls) if p.blocks]
    labels = []
    for p in pages:
        kept = {id(b) for b in main_blocks(p)}
        labels.append([id(b) in kept for b in p.blocks])
    if not pages:
        return ContentModel(fit_weights(np.zeros((0, len(FEATURES))), np.zeros(0)), *CAPACITIES[1])
    rows = [features(p) for p in pages]

    def weights(of: range) -> np.ndarray:
        some = [i for i in of if i < len(pages)] or [0]
        return fit_weights(np.vstack([rows[i] for i in some]), np.concatenate([labels[i] for i in some]).astype(float))

    half, best = weights(range(0, len(pages), 2)), (None, CAPACITIES[1])
    held = [(pages[i], np.clip(rows[i] @ half, -MOST, MOST).tolist(), labels[i]) for i in range(1, len(pages), 2)]
    for adjacent, same in CAPACITIES:
        wrong = sum(x != y for page, prefer, own in held for x, y in zip(min_cut(prefer, edges_of(page, adjacent, same)), own))
        if best[0] is None or wrong < best[0]:
            best = (wrong, (adjacent, same))
    return ContentModel(weights(range(len(pages))), *best[1])


def sample_pages(pages: DataFrame, html: str = "html_content", size: int = SAMPLE, most: int = SAMPLE_CHARS) -> list[str]:
    """At most ``size`` pages of at most ``most`` characters, chosen by the hash of their html."""
    there = pages.where(F.length(html).between(1, most)).select(F.xxhash64(html).alias("h"), F.col(html).alias("t"))
    last = there.select("h").distinct().orderBy("h").limit(size).agg(F.max("h")).first()[0]
    if last is None:
        return []
    return [r.t for r in there.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"]).orderBy("h").limit(size).collect()]


def content_blocks(page: Page, model: ContentModel, smooth: bool = True) -> list[Block]:
    """The blocks that the minimum cut puts on the content's side, in order."""
    return [b for b, yes in zip(page.blocks, model.labels(page, smooth)) if yes] if page.blocks else []


# ------------------------------------------------------------------------------------------------- kinds of markup

#: Elements of HTML by which a tag that shows as text is known. Fixed values.
TAG_NAMES = (
    "a abbr address article aside audio b big blockquote body br button caption center cite code col dd del details div dl "
    "dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins "
    "kbd label legend li link main mark meta nav noscript object ol option p param pre q ref s samp script section select "
    "small source span strike strong style sub summary sup svg table tbody td textarea tfoot th thead title tr tt u ul "
    "var video"
).split()
HTML = re.compile(r"</?(?:" + "|".join(TAG_NAMES) + r")(?:\s[^<>]*)?/?>|<!--.*?-->|&(?:[a-zA-Z][a-zA-Z0-9]{1,30}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});", re.I | re.S)
WIKI = re.compile(
    r"\[\[[^\[\]\n]+\]\]|\{\{[^{}]+\}\}|\{\|.*?\|\}|^\{\||^\|[-}]|^(={2,6})[^=\n].*?\1[ \t]*$|'{2,5}[^'\n]+'{2,5}"
    r"|\[https?://[^\s\]]+(?:[ \t][^\]\n]*)?\]|~{3,5}|__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__|^#(?:REDIRECT|ПЕРЕНАПРАВЛЕНИЕ)\b",
    re.M | re.S,
)
MARKDOWN = re.compile(
    r"!?\[[^\[\]\n]*\]\((?:https?://|/|\.{0,2}/|#|mailto:)[^()\s]*(?:[ \t]+\"[^\"\n]*\")?\)"
    r"|(?<![\w*])\*\*(?=[^\s*])[^*\n]*[^\s*]\*\*(?![\w*])|(?<![\w_])__(?=[^\s_])[^_\n]*[^\s_]__(?![\w_])"
    r"|(?<![\w*])\*(?=[^\s*])[^*\n]*[^\s*]\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])[^_\n]*[^\s_]_(?![\w_])|~~(?=[^\s~])[^~\n]+~~(?!~)"
    r"|`{1,3}[^`\n]+`{1,3}|^[ \t]*(?:```|~~~\w*$)|^ {0,3}\#{1,6}[ \t]+\S|^[^\n]*\S[^\n]*\n {0,3}(?:={3,}|-{3,})[ \t]*$"
    r"|^ {0,3}>[ \t]+\S|^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*\|[-|: \t]*$|^ {0,3}(?:[-*_][ \t]*){3,}$|^\[[^\]\n]+\]:[ \t]+\S+|\[[^\[\]\n]+\]\[[^\[\]\n]*\](?!\])"
    r"|^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]",
    re.M,
)
MARKDOWN_LIST = re.compile(r"^ {0,3}[-+*][ \t]+\S.*\n(?:.*\n)*? {0,3}[-+*][ \t]+\S", re.M)
LATEX = re.compile(
    r"\\(?:begin|end|(?:sub)*section|chapter|paragraph|textbf|textit|texttt|emph|underline|cite[pt]?|ref|label|footnote|caption|"
    r"includegraphics|usepackage|documentclass|title|author|href|url|frac|sqrt|sum|int|mathbf|mathrm|text)\*?(?:\[[^\]\n]*\])?\{"
    r"|\\\[.*?\\\]|\\\(.*?\\\)|\$\$[^$]+\$\$|\$(?=[^$\n]*[\\^_{}=])[^\s$](?:[^$\n]*[^\s$])?\$|\\item\b|\\(?:cdot|lambda|alpha|beta|gamma|pi|times|ldots|quad|maketitle|noindent|newline)\b|(?<=\s)\\\\(?=\s|$)",
    re.S,
)


#: Without any of these signs a text holds nothing that the patterns could find.
WIKI_SIGNS = ("[[", "{{", "{|", "|}", "|-", "==", "''", "[http", "~~~", "__", "#")
MARKDOWN_SIGNS = ("\n", "[", "*", "_", "`", "~", "#", ">", "|")


def kinds(text: str) -> set[str]:
    """The kinds of markup in a text as a reader sees it: markdown, wiki, latex, html."""
    out = set()
    if "<" in text or "&" in text:
        if HTML.search(text):
            out.add("html")
    latex = "\\" in text or "$" in text
    if latex and LATEX.search(text):
        out.add("latex")
    wiki = any(sign in text for sign in WIKI_SIGNS) and WIKI.search(text) is not None
    if wiki:
        out.add("wiki")
    rest = text
    if wiki:
        rest = WIKI.sub(" ", text)
    if "latex" in out:
        rest = LATEX_SPAN.sub(" ", rest)
    if "html" in out:
        rest = HTML.sub(" ", rest)
    if not any(sign in rest for sign in MARKDOWN_SIGNS) and rest.lstrip()[:1] not in ("-", "+"):
        return out
    if MARKDOWN.search(rest) or (not wiki and "\n" in rest and MARKDOWN_LIST.search(rest)):
        out.add("markdown")
    return out


LATEX_SPAN = re.compile(r"\\begin\{(\w+\*?)\}.*?\\end\{\1\}|\\\[.*?\\\]|\\\(.*?\\\)|\$\$[^$]+\$\$|\$[^$\n]+\$|\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?(?:\{[^{}]*\})?", re.S)

# ------------------------------------------------------------------------------------------------- conversion

_RULES: dict[str, list[tuple[re.Pattern, str]]] = {
    "html": [
        (re.compile(r"<!--.*?-->", re.S), ""),
        (re.compile(r"<h([1-6])(?:\s[^<>]*)?>(.*?)</h\1>", re.I | re.S), "\n# \\2\n"),
        (re.compile(r"<li(?:\s[^<>]*)?>", re.I), "\n- "),
        (re.compile(r"<pre(?:\s[^<>]*)?>(?:\s*<code(?:\s[^<>]*)?>)?(.*?)(?:</code>\s*)?</pre>", re.I | re.S), "\n```\n\\1\n```\n"),
        (re.compile(r"<(?:br|/p|/div|/tr|/ul|/ol|hr)(?:\s[^<>]*)?/?>", re.I), "\n"),
        (re.compile(r"</t[dh]>", re.I), "\t"),
        (re.compile(r"</?(?:" + "|".join(TAG_NAMES) + r")(?:\s[^<>]*)?/?>", re.I), ""),
    ],
    "latex": [
        (re.compile(r"\\(?:sub)*section\*?\{([^{}]*)\}|\\(?:chapter|title)\*?\{([^{}]*)\}"), "\n# \\1\\2\n"),
        (re.compile(r"\\begin\{(?:equation|align|displaymath|gather)\*?\}(.*?)\\end\{(?:equation|align|displaymath|gather)\*?\}", re.S), "\n$$\\1$$\n"),
        (re.compile(r"\\\[(.*?)\\\]", re.S), "$$\\1$$"),
        (re.compile(r"\\\((.*?)\\\)", re.S), "$\\1$"),
        (re.compile(r"\\(?:begin|end)\{(?:verbatim|lstlisting)\}"), "\n```\n"),
        (re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]\n]*\])?"), "\n"),
        (re.compile(r"^[ \t]*\\item(?:\[[^\]\n]*\])?[ \t]*", re.M), "- "),
        (re.compile(r"~?\\(?:cite[pt]?|ref|label)\*?(?:\[[^\]\n]*\])?\{[^{}]*\}"), ""),
        (re.compile(r"\\footnote\{([^{}]*)\}"), " (\\1)"),
        (re.compile(r"\\(?:textbf|textit|texttt|emph|underline|text|caption|author)\{([^{}]*)\}"), "\\1"),
        (re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}"), "\\1"),
        (re.compile(r"(?<=\s)\\\\(?=\s|$)"), "\n"),
        (re.compile(r"(?<=\S)~(?=\S)"), " "),
    ],
    "wiki": [
        (re.compile(r"^#+(?![#\w])[ \t]*", re.M), "1. "),
        (re.compile(r"^(={2,6})[ \t]*([^=\n].*?)[ \t]*\1[ \t]*$", re.M), "# \\2"),
        (re.compile(r"\{\|[^\n]*\n(.*?)\|\}", re.S), "\\1"),
        (re.compile(r"^\|-[^\n]*\n?", re.M), ""),
        (re.compile(r"^[!|][ \t]*", re.M), ""),
        (re.compile(r"[ \t]*(?:\|\||!!)[ \t]*"), "\t"),
        (re.compile(r"\[\[(?:Файл|File|Image|Изображение|Datei|Fichier|Категория|Category|Kategorie|Catégorie):[^\[\]]*\]\]", re.I), ""),
        (re.compile(r"\[\[[^\[\]|\n]*\|([^\[\]\n]*)\]\]"), "\\1"),
        (re.compile(r"\[\[([^\[\]\n]*)\]\]"), "\\1"),
        (re.compile(r"\[https?://\S+[ \t]+([^\]\n]*)\]"), "\\1"),
        (re.compile(r"\[https?://\S+\]"), ""),
        (re.compile(r"\{\{[^{}]*\}\}"), ""),
        (re.compile(r"'{2,5}"), ""),
        (re.compile(r"~{3,5}|__[A-Z]+__"), ""),
        (re.compile(r"^\*+[ \t]*", re.M), "- "),
    ],
    "markdown": [
        (re.compile(r"^([^\n]*\S[^\n]*)\n {0,3}(?:={3,}|-{3,})[ \t]*$", re.M), "# \\1"),
        (re.compile(r"^ {0,3}\#{1,6}[ \t]+(.*?)[ \t]*#*$", re.M), "# \\1"),
        (re.compile(r"!\[([^\[\]\n]*)\]\([^()\s]*(?:[ \t]+\"[^\"\n]*\")?\)"), "\\1"),
        (re.compile(r"\[([^\[\]\n]*)\]\([^()\s]*(?:[ \t]+\"[^\"\n]*\")?\)"), "\\1"),
        (re.compile(r"\[([^\[\]\n]+)\]\[[^\[\]\n]*\](?!\])"), "\\1"),
        (re.compile(r"(?<![\w*])(\*{1,3})(?=[^\s*])([^*\n]*[^\s*])\1(?![\w*])"), "\\2"),
        (re.compile(r"(?<![\w_\\])(_{1,3})(?=[^\s_])([^_\n]*[^\s_])\1(?![\w_])"), "\\2"),
        (re.compile(r"~~(?=[^\s~])([^~\n]+)~~"), "\\1"),
        (re.compile(r"^\[\^\w+\]:[ \t]*", re.M), "- "),
        (re.compile(r"\[\^\w+\]"), ""),
        (re.compile(r"(?<!`)`([^`\n]+)`(?!`)"), "\\1"),
        (re.compile(r"^ {0,3}>[ \t]?", re.M), ""),
        (re.compile(r"^[ \t]*[*+][ \t]+", re.M), "- "),
        (re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*\|[-|: \t]*$\n?", re.M), ""),
    ],
}
_LINES = re.compile(r"\n{3,}")


def cleaned(text: str, found: set[str] | None = None) -> str:
    """A text with its leftover markup turned into plain structure: '# ' before headings, '- ' before list items, code
    between ``` lines, formulas between dollar signs; link texts stay, their addresses, templates and citations go. ``found``: its kinds, if
    known."""
    found = kinds(text) if found is None else found
    for kind in ("html", "latex", "wiki", "markdown"):
        if kind in found:
            for pattern, to in _RULES[kind]:
                text = pattern.sub(to, text)
            if kind == "html":
                text = _html.unescape(_html.unescape(text))
    return _LINES.sub("\n\n", text).strip() if found else text


def page_text(page: Page, blocks: list[Block], found: list[set[str]] | None = None) -> str:
    """The clean text of content blocks, with the structure that the page's own elements give."""
    parts = []
    for b, own in zip(blocks, found or [None] * len(blocks)):
        tag = page.tags[b.node]
        text = b.text if b.pre else cleaned(b.text, own)
        if b.pre:
            text = f"```\n{text}\n```"
        elif tag in HEADINGS:
            text = "# " + text
        elif tag == "li":
            text = "- " + text
        parts.append(text)
    return "\n\n".join(parts)


def residue(pages: DataFrame, page_id: str = "page_id", html: str = "html_content", model: ContentModel | None = None) -> DataFrame:
    """(page_id, kinds, text) of every page with content: the kinds of markup left in content blocks outside ``pre``,
    and the clean text. Null and empty html gives no row; broken markup never fails; texts are read whole. ``model`` is
    fitted on a bounded sample of the pages, if none is given."""
    model = fit_content(sample_pages(pages, html)) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids, found, texts = [], [], []
                for i, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    page = parse(source)
                    blocks = content_blocks(page, model)
                    if blocks:
                        own = [set() if b.pre else kinds(b.text) for b in blocks]
                        ids.append(i)
                        found.append(sorted(set().union(*own)))
                        texts.append(page_text(page, blocks, own))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["page_id", "kinds", "text"])

    read = pages.where(F.length(html) > 0).select(F.col(page_id).cast("bigint").alias("page_id"), F.col(html).alias("html"))
    return spread(read).mapInArrow(run, "page_id bigint, kinds array<string>, text string")


def p6_found(spark, sf_dir: str) -> DataFrame:
    """The pages with leftover markup in their content, by kind."""
    return residue(spark.read.parquet(f"{sf_dir}/crawled.parquet")).select("page_id", F.explode("kinds").alias("kind")).distinct()


def p6_clean(spark, sf_dir: str) -> DataFrame:
    """The clean text of every page."""
    return residue(spark.read.parquet(f"{sf_dir}/crawled.parquet")).select("page_id", "text")


QUERIES = {"p6_found": p6_found, "p6_clean": p6_clean}
ORACLE: dict[str, str] = {}
