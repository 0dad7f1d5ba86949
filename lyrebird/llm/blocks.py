"""HTML pages as a light element tree with text blocks, and the tree scoring that finds a page's main body.

A *block* is the text between two neighbouring tags, where inline tags neither separate nor add anything. Head,
comments, scripts and styles are left out and entities are decoded once. The parser is one regular-expression pass with
implied end tags; broken markup never raises.
"""

from __future__ import annotations

import html as _html
import re

INLINE = frozenset("a abbr b code em font i small span strong sub sup u".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
#: Elements that end an open <p>.
ENDS_P = frozenset(
    "p div ul ol dl table section article aside header footer nav main form pre blockquote h1 h2 h3 h4 h5 h6 hr "
    "li td th tr tbody thead fieldset figure address".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is never part of an article.
CHROME = frozenset("nav aside footer form button select option label textarea noscript iframe".split())
#: An end tag of another kind doesn't close these.
SCOPE = frozenset("div table body html main section article".split())
#: Elements with implied ends: what stops the search for an open one of the same kind, and the kinds it ends.
SAME = {
    "li": (("ul", "ol"), ("li",)),
    "td": (("tr", "table"), ("td", "th")),
    "th": (("tr", "table"), ("td", "th")),
    "tr": (("table",), ("tr",)),
}
PARAGRAPH = frozenset("p li blockquote pre h1 h2 h3 h4 h5 h6 dd dt th td caption figcaption".split())

_ATTRS = "[^<>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^<>\"']*)*"
#: Inline tags other than links are taken out before the scan: they neither separate nor add anything.
QUIET = re.compile(r"</?(?:abbr|b|code|em|font|i|small|span|strong|sub|sup|u)(?:[\s/]" + _ATTRS + ")?>", re.I)
TOKEN = re.compile(
    r"<(?:!--(?:[^-]|-(?!->))*(?:-->|\Z)"
    r"|([sShH](?:[cC][rR][iI][pP][tT]|[tT][yY][lL][eE]|[eE][aA][dD]))(?=[\s>/]).*?(?:</(?i:\1)\s*>|\Z)"
    r"|(/?)([a-zA-Z][a-zA-Z0-9]*)(" + _ATTRS + ")>"
    r"|[!?/][^>]*>)",
    re.S,
)
#: Tags begun at the end of the source.
UNFINISHED = re.compile(r"(?:</?[a-zA-Z][a-zA-Z0-9]*)+\Z|<\Z")
ATTR = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile("[a-z0-9а-яё]{2,}")
DIGITS = re.compile(r"\d+")
#: The only characters outside A-Z, А-Я, Ё whose str.lower() holds letters of a word.
ODD = re.compile("[\u0130\u212a]")


def words(text: str) -> list[str]:
    """Maximal runs of two or more of a-z 0-9 а-я ё after A-Z, А-Я, Ё were lower-cased."""
    if not text.isascii() and ODD.search(text):
        text = ODD.sub("\0", text)
    return WORD.findall(text.lower())


class Block:
    """One text block. ``node`` is its nearest enclosing block element."""

    __slots__ = ("link", "node", "pre", "text")

    def __init__(self, text: str, node: int, link: int, pre: bool):
        self.text, self.node, self.link, self.pre = text, node, link, pre


class Page:
    """Element arrays (tag, parent, class and id text) and the blocks in document order; node 0 is the root."""

    __slots__ = ("blocks", "hints", "parents", "tags")

    def __init__(self) -> None:
        self.tags, self.parents, self.hints, self.blocks = ["#root"], [-1], [""], []


def parse(source: str) -> Page:
    """The page's tree and blocks: every text that isn't blank, in whatever script."""
    page = Page()
    tags, parents, hints, out = page.tags, page.parents, page.hints, page.blocks
    stack = [0]
    text: list[str] = []
    links = 0  # characters of the current block inside <a>
    in_a = False
    pres = 0
    parts = TOKEN.split(QUIET.sub("", source))
    if "<" in parts[-1]:
        parts[-1] = UNFINISHED.sub("", parts[-1])
    parts += (None, None, None, None)  # the end flushes like a tag
    for i in range(0, len(parts), 5):
        piece = parts[i]
        if piece:
            text.append(piece)
            if in_a:
                links += len(piece)
        name = parts[i + 3]
        if name is not None:
            name = name.lower()
            if name == "a":
                in_a = not parts[i + 2]
                continue
        if text:
            raw = text[0] if len(text) == 1 else "".join(text)
            text.clear()
            if not raw.isspace():
                if "&" in raw:
                    raw = _html.unescape(raw)
                raw = raw.strip()
                if raw:
                    out.append(Block(raw, stack[-1], links, pres > 0))
        links = 0
        if name is None:
            continue
        top = tags[stack[-1]]
        if name in VOID:
            if name == "hr" and top == "p":
                stack.pop()
            continue
        if parts[i + 2]:
            in_a = False
            if top == name:
                stack.pop()
                pres -= name == "pre"
                continue
            for k in range(len(stack) - 1, 0, -1):
                tag = tags[stack[k]]
                if tag == name:
                    pres -= sum(tags[node] == "pre" for node in stack[k:])
                    del stack[k:]
                    break
                if tag in SCOPE and name not in SCOPE:
                    break
            continue
        if name in ENDS_P:
            in_a = False
            while tags[stack[-1]] == "p":
                stack.pop()
            if name in SAME:
                stop, same = SAME[name]
                for k in range(len(stack) - 1, 0, -1):
                    tag = tags[stack[k]]
                    if tag in stop:
                        break
                    if tag in same:
                        del stack[k:]
                        break
        attrs = parts[i + 4]
        hints.append(" ".join(a or b or c for a, b, c in ATTR.findall(attrs)).lower() if attrs and "=" in attrs else "")
        tags.append(name)
        parents.append(stack[-1])
        stack.append(len(tags) - 1)
        pres += name == "pre"
    return page


# ------------------------------------------------------------------------------------------------ tree scoring

#: Names of classes and ids by which pages mark what isn't their main text.
CHROME_HINTS = frozenset("share social ad ads advert banner cookie menu nav footer sidebar related comments".split())


def mark_chrome(page: Page) -> tuple[list[bool], list[bool]]:
    """Elements and blocks that are page chrome by the tag, class or id of an element around them. No wording counts:
    lines that sites repeat are found by counts over all pages (``pages.repeated_lines``)."""
    tags, parents, hints = page.tags, page.parents, page.hints
    node_chrome = [tags[n] in CHROME or hints[n] in CHROME_HINTS for n in range(len(tags))]
    for n in range(1, len(tags)):
        if node_chrome[parents[n]]:
            node_chrome[n] = True
    return node_chrome, [node_chrome[b.node] for b in page.blocks]


COMMAS = re.compile("[,،、，]")
EAST = re.compile("[\u0600-\u06ff\u3000-\uffff]")
WIDE = re.compile("[\u3000-\u9fff\uac00-\ud7af\uf900-\ufaff]")


def weight_of(text: str) -> tuple[int, int]:
    """A text's length, in which an ideograph or a syllable counts twice, and its commas."""
    if text.isascii() or not EAST.search(text):
        return len(text), text.count(",")
    return len(text) + len(WIDE.findall(text)), len(COMMAS.findall(text))


#: Elements that only hold parts of a table or list; their paragraphs' points go to what holds the whole.
PARTS = frozenset("tr tbody thead table ul ol dl".split())


def score_tree(page: Page, skip: list[bool]) -> list[float]:
    """Each element's score: every paragraph passes points to its parent and half of them to its grandparent; the sum
    is discounted by the element's link density.

    A paragraph is a text block that isn't skipped, short or mostly a link. Its points are one, one more for each comma
    and one for each hundred characters (three at most), a quarter of that in a list. A text that stands beside others
    in one element (divided by ``br``) passes its points to that element itself. ``article`` counts double.
    """
    tags, parents, blocks = page.tags, page.parents, page.blocks
    size = len(tags)
    children, held = [0] * size, [0] * size
    for node in range(1, size):
        children[parents[node]] += 1
    for block in blocks:
        held[block.node] += 1
    points, chars, links = [0.0] * size, [0] * size, [0] * size
    for block, skipped in zip(blocks, skip):
        node, length, link = block.node, len(block.text), block.link
        chars[node] += length
        links[node] += min(link, length)
        size_of, commas = weight_of(block.text)
        if skipped or size_of < 25 or 2 * link > length or tags[node] in HEADINGS:
            continue
        tag = tags[node]
        if tag in ("td", "th", "li") and held[node] == 1 and not children[node]:
            to = parents[node]
            while to > 0 and tags[to] in PARTS:
                to = parents[to]
            value = (1 + commas + min(size_of / 100, 3)) / 4
        else:
            to = node if held[node] > 1 or (children[node] and tag not in PARAGRAPH) else parents[node]
            value = 1 + commas + min(size_of / 100, 3)
        if to > 0:
            points[to] += value
            if parents[to] > 0:
                points[parents[to]] += value / 2
    for node in range(size - 1, 0, -1):
        chars[parents[node]] += chars[node]
        links[parents[node]] += links[node]
    return [points[n] * (1 - links[n] / chars[n]) * (2 if tags[n] == "article" else 1) if chars[n] else 0.0 for n in range(size)]


def best_containers(page: Page, score: list[float], least: float = 1.5, share: float = 0.5) -> list[int]:
    """The best container and those of its siblings of the same kind that score at least ``share`` of it; none if no
    element scores ``least`` (``body``: twice that)."""
    tags, parents, hints = page.tags, page.parents, page.hints
    top = max(range(len(score)), key=score.__getitem__)
    if score[top] < (2 * least if tags[top] in ("body", "#root", "html", "main") else least):
        return []
    if tags[top] in ("body", "#root", "html"):
        return [top]
    return [n for n in range(1, len(score)) if n == top or (parents[n] == parents[top] and tags[n] == tags[top] and hints[n] == hints[top] and score[n] >= share * score[top])]


def main_blocks(page: Page, marks: tuple[list[bool], list[bool]] | None = None, roots: list[int] | None = None) -> list[Block]:
    """The blocks of the page's main body, in order: those in the best container and its siblings without the chrome
    inside. Where ``body`` itself is the container, paragraphs of the lesser kind (``p`` among ``div`` or the other way
    round) and bare link lists don't belong; neither do link lists without a figure anywhere, nor a paragraph that is
    mostly a link. ``marks`` and ``roots`` are those of ``mark_chrome`` and ``best_containers``, where they are known
    already."""
    if not page.blocks:
        return []
    tags, parents, blocks = page.tags, page.parents, page.blocks
    node_chrome, block_chrome = marks or mark_chrome(page)
    roots = best_containers(page, score_tree(page, block_chrome)) if roots is None else roots
    if not roots:
        return []
    keep = [False] * len(tags)
    chosen = set(roots)
    for node in range(len(tags)):
        keep[node] = not node_chrome[node] and (node in chosen or (node > 0 and keep[parents[node]]))
    out = [b for b, chrome in zip(blocks, block_chrome) if keep[b.node] and not chrome]
    out = [b for b in out if 2 * b.link <= len(b.text) or tags[b.node] in HEADINGS or tags[b.node] in ("li", "td", "th", "dd", "dt")]
    loose = tags[roots[0]] in ("body", "#root", "html")
    if loose:
        by: dict[str, int] = {}
        for b in out:
            if parents[b.node] == roots[0] and 2 * b.link <= len(b.text):
                by[tags[b.node]] = by.get(tags[b.node], 0) + len(b.text)
        lesser = ("p" if by["p"] < by["div"] else "div") if "p" in by and "div" in by else ""
        out = [b for b in out if not (tags[b.node] == lesser and parents[b.node] == roots[0])]
        out = [b for b in out if not (b.node == roots[0] and 2 * b.link > len(b.text))]
        lines: dict[int, list[int]] = {}  # a child with many short lines is a menu
        for b in out:
            lines.setdefault(b.node, []).append(len(b.text))
        out = [b for b in out if b.node == roots[0] or len(lines[b.node]) < 3 or max(lines[b.node]) > 60]
    # link lists: all texts of a list or a run of siblings are links
    group: dict[int, list[Block]] = {}
    for b in out:
        group.setdefault(parents[b.node] if tags[b.node] not in ("td", "th", "tr") else b.node, []).append(b)
    drop: set[int] = set()
    for where, own in group.items():
        linked = [b for b in own if 10 * b.link >= 6 * len(b.text)]
        if where in chosen:
            if loose:
                drop.update(id(b) for b in linked if not DIGITS.search(b.text))
        elif len(linked) >= 2 and len(linked) == len(own) and sum(DIGITS.search(b.text) is not None for b in linked) * 2 < len(linked):
            drop.update(id(b) for b in linked)
    return [b for b in out if id(b) not in drop]
