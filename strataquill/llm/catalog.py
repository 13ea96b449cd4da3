"""All queries of this subpackage, by name."""

from __future__ import annotations

from strataquill.llm import bilingual, cut_text, encoding, languages, leaks, nearest, pairs, quality, scanned

_MODULES = (bilingual, cut_text, encoding, languages, leaks, nearest, pairs, quality, scanned)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
