"""Queries by name: a function over Tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: SQL that pairs all rows of a chat: the tests run it over the smallest tables, larger ones take it too long.
SLOW_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, slow: bool = False):
    """Register f(tables) under a name."""

    def add(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} twice")
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            (SLOW_SQL if slow else ORACLES)[name] = oracle(sql)
        return f

    return add
