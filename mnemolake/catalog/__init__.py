"""Registered queries over the given tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MODULES = ["text_queries", "retrieval_queries", "concept_queries", "fact_queries", "lifecycle_queries",
           "similarity_queries", "store_queries", "plan_queries", "stream_queries", "chain_queries", "portable_queries", "keeping_queries", "recall_queries"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the DuckDB statement with the same result."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in MODULES:
        import_module(f"{__name__}.{module}")
    return QUERIES, SQL
