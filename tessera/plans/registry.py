"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from tessera.plans import analytics, lifecycle, papers, text, vectors

MODULES = (vectors, text, lifecycle, analytics, papers)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
