"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

_NAMES = ("neardup", "encoding", "frequencies", "distinctive", "pages", "markup", "tokens", "packing", "lookalikes")
_MODULES = [import_module(f"lyrebird.llm.{n}") for n in _NAMES]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
