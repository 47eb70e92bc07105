"""The registered queries, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@dataclass(frozen=True)
class Star:
    """The tables of a folder, read when asked for."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query, with its SQL if there is one."""

    def register(f: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Star(spark, folder))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register
