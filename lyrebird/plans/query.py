"""The Boolean query language: a tolerant, stateless parser, simplification, and compilation to Spark columns.

    or      := and ( "||" and )*
    and     := not ( "&&" not | not )*      two terms side by side mean AND
    not     := "!" not | primary
    primary := "(" or ")" | TERM            the closing bracket may be missing

What can't be parsed ends the query without an error; operands that are missing are left out; a query without any
operand has no tree and no hits.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lyrebird.functions.text import LOWER, UPPER


@dataclass(frozen=True)
class Term:
    text: str

    def __str__(self) -> str:
        return self.text


@dataclass(frozen=True)
class Not:
    operand: Node

    def __str__(self) -> str:
        return f"NOT({self.operand})"


@dataclass(frozen=True)
class And:
    operands: tuple[Node, ...]

    def __str__(self) -> str:
        return f"AND({', '.join(map(str, self.operands))})"


@dataclass(frozen=True)
class Or:
    operands: tuple[Node, ...]

    def __str__(self) -> str:
        return f"OR({', '.join(map(str, self.operands))})"


Node = Term | Not | And | Or

_LEXEME = re.compile(r"(?P<blank>[ \t\n\v\f\r]+)|(?P<op>\|\||&&|[!()])|(?P<term>[A-Za-z0-9А-Яа-яЁё_-]+)|(?P<other>.)", re.S)


def lexemes(query: str) -> list[str]:
    """Operators, brackets and terms in order, up to the first character that belongs to none: it ends the query
    wherever it stands, except that it also takes the place of a missing operand, which is why it is kept as ''."""
    out = []
    for m in _LEXEME.finditer(query):
        if m.lastgroup != "blank":
            out.append("" if m.lastgroup == "other" else m.group())
    return out


class _Reader:
    def __init__(self, items: list[str]):
        self.items, self.at = items, 0

    def ahead(self) -> str | None:
        return self.items[self.at] if self.at < len(self.items) else None

    def take(self, item: str) -> bool:
        if self.ahead() == item:
            self.at += 1
            return True
        return False

    def either(self) -> Node | None:
        parts = [self.every()]
        if parts[0] is None:
            return None
        while self.take("||"):
            parts.append(self.every())
        return _joined(Or, parts)

    def every(self) -> Node | None:
        parts = [self.negated()]
        if parts[0] is None:
            return None
        while True:
            if self.take("&&"):
                parts.append(self.negated())
                continue
            item = self.ahead()
            if not item or item in ("||", ")") or item[0] in "-_":
                break  # a term that begins with - or _ needs an explicit &&
            more = self.negated()
            if more is None:
                break
            parts.append(more)
        return _joined(And, parts)

    def negated(self) -> Node | None:
        flips = 0
        while self.take("!"):
            flips += 1
        node = self.primary()
        for _ in range(flips if node is not None else 0):
            node = Not(node)
        return node

    def primary(self) -> Node | None:
        if self.take("("):
            node = self.either()
            self.take(")")
            return node
        item = self.ahead()
        if item and item not in ("||", "&&", "!", "(", ")"):
            self.at += 1
            return Term(item)
        return None


def _joined(kind: type, parts: list[Node | None]) -> Node:
    there = tuple(p for p in parts if p is not None)
    return there[0] if len(there) == 1 else kind(there)


def parse(query: str | None) -> Node | None:
    """The tree of a query; None if it has no operand."""
    return _Reader(lexemes(query or "")).either()


_FOLD = str.maketrans(UPPER, LOWER)


def fold(term: str) -> str:
    """A query term as the index has it: lower case of A-Z, А-Я, Ё; not cut into tokens."""
    return term.translate(_FOLD)


def terms(node: Node | None) -> list[str]:
    """The distinct folded terms of a tree that an index can hold, in order of appearance."""
    out: dict[str, None] = {}

    def walk(n: Node) -> None:
        if isinstance(n, Term):
            if can_match(n):
                out[fold(n.text)] = None
        elif isinstance(n, Not):
            walk(n.operand)
        else:
            for o in n.operands:
                walk(o)

    if node is not None:
        walk(node)
    return list(out)


def can_match(term: Term) -> bool:
    """A term of one character, or with - or _, is in no index."""
    return len(term.text) > 1 and not set(term.text) & set("-_")


def holds(node: Node, present: dict[str, bool]) -> bool:
    """The truth of a tree for a document with the given terms."""
    if isinstance(node, Term):
        return can_match(node) and present.get(fold(node.text), False)
    if isinstance(node, Not):
        return not holds(node.operand, present)
    values = (holds(o, present) for o in node.operands)
    return all(values) if isinstance(node, And) else any(values)


def compiled(node: Node, flag) -> Column:
    """The tree as a Boolean column; ``flag`` gives the column of a folded term. Terms that can't match are false."""
    if isinstance(node, Term):
        return flag(fold(node.text)) if can_match(node) else F.lit(False)
    if isinstance(node, Not):
        return ~compiled(node.operand, flag)
    parts = [compiled(o, flag) for o in node.operands]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if isinstance(node, And) else (out | p)
    return out


def set_sql(node: Node | None, postings: str = "postings", docs: str = "docs") -> str:
    """The tree as a query of set operations over postings(term, doc_id) and docs(doc_id): one scan for each leaf. It
    shares nothing with the fused plan, which it checks."""
    if node is None:
        return f"select doc_id from {docs} where false"
    if isinstance(node, Term):
        text = fold(node.text).replace("'", "''")
        return f"select doc_id from {postings} where term = '{text}'"
    if isinstance(node, Not):
        return f"(select doc_id from {docs}) except ({set_sql(node.operand, postings, docs)})"
    word = "intersect" if isinstance(node, And) else "union"
    return f" {word} ".join(f"(select doc_id from ({set_sql(o, postings, docs)}))" for o in node.operands)
