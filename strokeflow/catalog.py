"""Operator id to query: what the driver runs on its tables, with oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query; ``sql`` may use the entity views of :mod:`strokeflow.plans.bindings` by name."""

    def add(query: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = query
        if sql is not None:
            from .plans.bindings import with_entities

            ORACLES[name] = with_entities(sql)
        return query

    return add


def load() -> None:
    """Import every module that registers queries."""
    from .plans import aggregate_queries, attribution_queries, camera_queries, detection_queries, document_queries, evaluation_queries, function_queries, join_queries, judging_queries, model_queries, remaining_queries, scan_queries, session_queries, set_queries, stream_queries, window_queries  # noqa: F401
