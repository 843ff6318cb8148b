"""Where queries and the SQL they are checked against are gathered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of named tables, given as the names of its parameters; ``spark`` is the session."""

    def add(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        names = make.__code__.co_varnames[: make.__code__.co_argcount]
        QUERIES[make.__name__] = lambda spark, sf_dir: make(*(spark if n == "spark" else table(spark, sf_dir, n) for n in names))
        if sql:
            ORACLE_SQL[make.__name__] = sql
        return make

    return add
