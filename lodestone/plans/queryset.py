"""A module's queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class QuerySet:
    """Registers a query: a function of a table loader, and its SQL where there is one."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

            run.__doc__ = f.__doc__
            self.queries[name] = run
            if sql:
                self.oracle[name] = sql
            return f

        return add
