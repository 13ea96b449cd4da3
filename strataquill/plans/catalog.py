"""All queries of the core, by name."""

from __future__ import annotations

from strataquill.plans import composite_queries, lookup_queries, orphan_queries, relational_queries, retrieval_queries, streaming_queries, text_queries

_MODULES = (composite_queries, lookup_queries, orphan_queries, relational_queries, retrieval_queries, streaming_queries, text_queries)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
