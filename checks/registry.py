"""Pairs of a Spark query and the SQL it must agree with."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapters import Data

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of ``Data`` under its name, with its SQL if there is one."""
    def add(function: Callable[[Data], DataFrame]):
        name = function.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(Data(spark, folder))

        run.__module__ = function.__module__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function
    return add
