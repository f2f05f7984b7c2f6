"""Joins of spans across rows: which spans of one table overlap which of another, within a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Places in a bin. About the length of a usual span: shorter bins repeat spans, longer ones bring strangers together.
BIN = 128


def _binned(df: DataFrame, start: str, end: str, size: int) -> DataFrame:
    """Each span once for every bin that it touches."""
    bins = F.sequence(F.floor(F.col(start) / size), F.floor((F.col(end) - 1) / size))
    return df.where(F.col(start) < F.col(end)).withColumn("_bin", F.explode(bins))


def overlapping(left: DataFrame, right: DataFrame, by: list[str], *, size: int = BIN) -> DataFrame:
    """Pairs of spans [a_start, a_end) of ``left`` and [b_start, b_end) of ``right`` that share a place and the keys ``by``.

    An equi-join on the keys and fixed bins; a pair that meets in several bins is kept in the first
    one that both touch, so no pair comes twice and nothing has to be made distinct. Spans that are empty
    or have a null end pair with nothing. Further columns stay; their names must differ.
    """
    met = _binned(left, "a_start", "a_end", size).join(_binned(right, "b_start", "b_end", size), [*by, "_bin"])
    first = F.floor(F.greatest("a_start", "b_start") / size)
    return met.where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & (F.col("_bin") == first)).drop("_bin")


def runs(places: DataFrame, by: str, at: str = "at") -> DataFrame:
    """Maximal runs of neighbouring distinct places of each key, as ``a_start``, ``a_end``."""
    island = F.col(at) - F.row_number().over(Window.partitionBy(by).orderBy(at))
    return places.withColumn("_island", island).groupBy(by, "_island").agg(F.min(at).alias("a_start"), (F.max(at) + 1).alias("a_end")).drop("_island")


def contained(pairs: DataFrame) -> DataFrame:
    """Of overlapping() those whose first span lies within the second."""
    return pairs.where("a_start >= b_start and a_end <= b_end")
