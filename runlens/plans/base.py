"""Registration of named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder: called with a name it reads one; ``path`` gives the place, for streams."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(name: str, sql: str | None = None) -> Callable:
    def keep(fn: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, d: fn(Tables(spark, d))
        if sql:
            SQL[name] = sql
        return fn

    return keep
