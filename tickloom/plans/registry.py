"""All registered queries: name -> (Spark callable, DuckDB text or None)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

AREAS = ("spread_queries", "pairs_queries", "token_queries", "signal_queries", "trading_queries", "table_queries", "stream_queries")


def _all() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}
    for area in AREAS:
        for name, pair in import_module(f"tickloom.plans.{area}").QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} registered twice")
            out[name] = pair
    return out


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _all().items() if text is not None}
