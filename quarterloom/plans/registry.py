"""All queries of the core, and the SQL that checks them."""

from __future__ import annotations

from quarterloom.plans import io_queries, market_queries, panel_queries, text_queries, time_queries

_MODULES = (text_queries, panel_queries, market_queries, time_queries, io_queries)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in _MODULES for name, text in module.ORACLE.items()}
