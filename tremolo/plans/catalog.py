"""Registered queries over the driver's tables, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from tremolo.plans import part_queries, signal_queries, text_queries

_MODULES = (signal_queries, text_queries, part_queries)


def queries() -> dict[str, Callable]:
    return {k: q for m in _MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.ORACLE.items()}
