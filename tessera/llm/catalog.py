"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import decontaminate, html_text, jaccard_join, licenses, packing, preferences, quality_model, quality_rules, toxicity, warc

MODULES = (packing, quality_model, licenses, toxicity, preferences, decontaminate, html_text, quality_rules, warc, jaccard_join)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
