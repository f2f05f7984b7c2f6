"""Top-k, first-wins and last-wins selections with explicit tie rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import settle


def ranked(df: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    """A 1-based rank in each group; with a later filter on it, Spark prunes groups before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def top_k(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    return ranked(df, by, order, name).where(F.col(name) <= k)


def first_wins(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """One row for each group: the first in ``order``."""
    return ranked(df, by, order, "_first").where("_first = 1").drop("_first")


def last_wins(df: DataFrame, by: list[str], seq: str) -> DataFrame:
    """One row for each group, that with the greatest ``seq``; aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(*[F.max_by(c, seq).alias(c) for c in rest]).select(*df.columns)


def ranked_by_ranges(df: DataFrame, by: list[str], order: list, name: str = "rank", size: str | None = None) -> DataFrame:
    """As ranked(), with no group in one task: also where a group holds most rows.

    Rows are spread by ranges of group and order (bounds from a sample), counted by range, and numbered
    within a range behind the rows of the ranges before. ``order`` ends in something unique, so that
    equal rows can be parted; ``size`` names a column for the number of rows of the group.
    """
    placed = settle(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = placed.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = counts.select(*by, "_range", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias("_all"))
    keys = [F.coalesce(F.to_json(F.struct(*by)), F.lit("")).alias("_key")]  # groups may be null
    inside = placed.withColumn(name, F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))).select("*", *keys)
    found = inside.join(offsets.select("_range", "_before", "_all", *keys), ["_key", "_range"])
    found = found.withColumn(name, (F.col(name) + F.col("_before")).cast("long"))
    return found.select(*df.columns, name, *([F.col("_all").alias(size)] if size else []))
