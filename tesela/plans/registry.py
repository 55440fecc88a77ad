"""A registry of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    """Queries by name; ``QUERIES`` and ``ORACLES`` feed the entry point."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.ORACLES: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        """Register the decorated query, with its DuckDB twin if there is one."""

        def add(f):
            self.QUERIES[f.__name__] = f
            if sql:
                self.ORACLES[f.__name__] = sql
            return f

        return add
