"""All queries by name, and the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from . import other_queries, search_queries, text_queries

MODULES = (text_queries, search_queries, other_queries)


def queries() -> dict:
    return dict(text_queries.Q)


def oracle_sql() -> dict[str, str]:
    return dict(text_queries.SQL)
