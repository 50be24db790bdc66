"""Queries by name, and the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import Fixtures, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False):
    """Registers f(fixtures) -> DataFrame under the function's name, with its check."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = oracle(sql, recursive)
        return f

    return add
