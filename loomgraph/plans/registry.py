"""Collects a module's queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        """Registers a function of Tables, with its SQL, under its own name."""

        def register(f: Callable[[Tables], DataFrame]):
            key = name or f.__name__
            self.queries[key] = lambda spark, folder: f(Tables(spark, folder))
            if sql:
                self.sql[key] = sql
            return f

        return register
