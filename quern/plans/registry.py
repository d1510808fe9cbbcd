"""All queries of the library, with their SQL."""

from __future__ import annotations

from quern.shipping import shipped

from . import chunk_queries, metric_queries, search_queries, table_queries, text_queries

_MODULES = [text_queries, chunk_queries, search_queries, metric_queries, table_queries]

flagship = search_queries.flagship


def queries() -> dict:
    return {name: shipped(f) for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: s for m in _MODULES for name, s in m.SQL.items()}
