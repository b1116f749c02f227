"""The registered queries of the selection engine and their DuckDB twins."""

from __future__ import annotations

from tessella.plans import book, budgets, coverage, reports, rules, selection, stores, views

MODULES = (selection, coverage, budgets, reports, rules, stores, views)


def queries() -> dict:
    return dict(book.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(book.ORACLES)
