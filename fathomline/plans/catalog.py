"""Registered queries over the given tables, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register a function of Tables under its name, with its SQL."""

    def add(make: Callable[[Tables], DataFrame]):
        key = name or make.__name__
        QUERIES[key] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql:
            ORACLES[key] = sql
        return make

    return add


def load() -> None:
    """Import the modules that register queries."""
    from . import detail_queries, graph_queries, index_queries, more_queries, ops_queries, retrieval_queries, text_queries  # noqa: F401
