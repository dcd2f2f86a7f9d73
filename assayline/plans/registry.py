"""The list of named queries over the standard tables, each with its SQL equivalent if any."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


@dataclass(frozen=True)
class Tables:
    """Lazily read tables of one data folder: ``tables.orders`` is a parquet scan."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}.parquet")

    def views(self, *names: str) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in names}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a plan builder under a name, with the SQL text that must give the same rows."""
    def register(build: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return build

    return register
