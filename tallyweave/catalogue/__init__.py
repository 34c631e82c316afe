"""Registered queries over the driver's tables, each with the same result as SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tallyweave.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """The input tables by name, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` under ``name``."""

    def register(f: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return register


MODULES = ["linking", "scalars", "series", "predicates", "aggregates", "profiles", "rules", "sources", "lookups", "incremental", "store", "uddf", "boards"]


def load() -> None:
    for module in MODULES:
        import_module(f"tallyweave.catalogue.{module}")
