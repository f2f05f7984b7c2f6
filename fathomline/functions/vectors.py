"""Similarities of array columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import as_column


def doubles(v) -> Column:
    return as_column(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b) -> Column:
    """0 where a vector is zero or their lengths differ."""
    same = F.size(as_column(a)) == F.size(as_column(b))
    size = norm(a) * norm(b)
    return F.when(same & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def negative_distance(a, b) -> Column:
    return -F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def truncated(v, dims: int) -> Column:
    """The first ``dims`` components at length 1, where the vector is longer; else unchanged."""
    short = F.slice(doubles(v), 1, dims)
    size = F.sqrt(F.aggregate(short, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(F.size(as_column(v)) > dims, F.when(size > 0, F.transform(short, lambda x: x / size)).otherwise(short)).otherwise(doubles(v))
