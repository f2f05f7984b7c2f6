"""Writers and the rows that they write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import last_wins


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def json_rows(df: DataFrame, key: str, name: str = "json") -> DataFrame:
    """``key`` and each row as JSON; null fields are left out."""
    return df.select(F.col(key), F.to_json(F.struct(*df.columns)).alias(name))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> bool:
    """Files with a header; nothing is written, and False returned, if there is no row."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").csv(path, header=True)
    return True


def upsert_vectors(old: DataFrame, new: DataFrame, key: str = "vec_id") -> DataFrame:
    """Both tables, the new row of a key first."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    return last_wins(both, [key], "_seq").drop("_seq")


def delete(old: DataFrame, keys: DataFrame, key: str = "vec_id") -> DataFrame:
    return old.join(keys.select(key), key, "left_anti")


def upsert_counts(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Counts of known keys replaced, new keys added."""
    a, b = old.alias("a"), new.alias("b")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in columns])
