"""Name -> query and SQL. Operators are functions over DataFrames; a registered query applies one to a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans.model import Model, prelude

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, make: Callable[[Model], DataFrame], sql: str | None = None) -> None:
    """`make` gets the model of the folder; `sql` may name model tables and begins with SELECT or with expressions."""
    QUERIES[name] = lambda spark, sf_dir: make(Model(spark, sf_dir))
    if sql:
        ORACLES[name] = prelude(sql)


def load() -> None:
    """Import every module that registers queries."""
    from .plans import catalog  # noqa: F401
