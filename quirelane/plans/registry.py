"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add a query under ``name``, with its DuckDB twin where there is one."""

    def add(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


from quirelane.plans import document_queries, further_queries, layout_queries, output_queries, pdf_queries, repair_queries, scalar_queries, search_queries, stream_queries, tree_queries  # noqa: E402, F401
