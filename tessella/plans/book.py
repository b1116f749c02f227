"""The book of registered queries: each under its function's name, with its SQL over the fixtures that it uses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_fixtures(sql: str, uses: tuple[str, ...]) -> str:
    """SQL with the fixtures' common table expressions before its own."""
    if not uses:
        return sql
    own = sql.lstrip()
    head = next((h for h in ("WITH RECURSIVE ", "WITH ") if own.upper().startswith(h)), "")
    return f"{head or 'WITH '}{', '.join(fixtures.SQL[u] for u in uses)}" + (", " + own[len(head) :] if head else "\n" + sql)


def register(sql: str | None = None, *uses: str):
    def add(query):
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = with_fixtures(sql, uses)
        return query

    return add
