"""Where query modules enter their queries with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries of one module by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def enter(fn: Query) -> Query:
            key = name or fn.__name__
            if key in self.queries:
                raise ValueError(f"two queries are named {key}")
            self.queries[key] = fn
            if sql:
                self.sql[key] = sql
            return fn

        return enter
