"""Named queries over the test tables, each with its DuckDB oracle SQL.

Every query reads whole tables (through the adapters) and returns a lazy
DataFrame. Keys follow the operator inventory; a query without an oracle
entry is checked by row count only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None,
             ctes: tuple[tuple[str, str], ...] = ()) -> Callable[[Query], Query]:
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *ctes)
        return fn
    return deco


def _load() -> None:
    # importing the modules registers their queries
    from . import q_ingest, q_page, q_sources, q_stats, q_audit, q_store, q_stream  # noqa: F401


_load()
