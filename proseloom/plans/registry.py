"""Named queries over the given tables and the SQL that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its check where SQL can state it."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check
        return fn

    return add


def load() -> None:
    """Import every family once."""
    from . import queries_book, queries_events, queries_project, queries_text  # noqa: F401
