"""The engine's registered queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query ``(spark, sf_dir) -> DataFrame``, and its SQL if there is one."""

    def add(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


from . import activity_queries, fit_queries, match_queries, output_queries, sequence_queries  # noqa: E402, F401
