"""The registered queries: name -> (query, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_REGISTERED: dict[str, tuple[Query, str | None]] = {}


def register(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Decorator: adds a query and, where SQL can express it, its DuckDB oracle."""

    def add(query: Query) -> Query:
        key = name or query.__name__
        if key in _REGISTERED:
            raise ValueError(f"{key} is registered twice")
        _REGISTERED[key] = (query, sql)
        return query

    return add


def _load() -> dict[str, tuple[Query, str | None]]:
    from corpuswright.plans import assign_queries, conversation_queries, encoding_queries, metric_queries, order_queries, report_queries, row_queries, scoring_queries, source_queries, spatial_queries, stream_queries, text_queries  # noqa: F401

    return _REGISTERED


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _load().items() if sql}
