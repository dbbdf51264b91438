"""All queries that do not belong to the corpus part."""

from __future__ import annotations

from . import annotation_queries, chain_queries, domain_queries, function_queries, guard_queries, layout_queries, more_queries, queries as first, set_queries, sink_queries  # noqa: F401  they register themselves


def queries() -> dict:
    return dict(first.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(first.SQL)
