"""Tables that are kept by key: an upsert or a removal rewrites only the partitions that it touches.

A table is a folder of Parquet with ``bucket=B``, a hash of the key. New rows are merged with the old
rows of their buckets into a table of their own first, and only a whole one replaces those
partitions (Spark's dynamic overwrite), so a job that fails before leaves the old rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import settle

BUCKETS = 64


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    spread = rows.hint("rebalance", "bucket")
    spread.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def create(rows: DataFrame, path: str, key: str, *, buckets: int = BUCKETS) -> None:
    """Write a new table; keys are unique and not null. The number of buckets stays as it is."""
    _write(rows.withColumn("bucket", _bucket(key, buckets)), path, "errorifexists")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows, with their ``bucket``; ``schema`` is that of the other columns."""
    return spark.read.schema(f"{schema}, bucket int").parquet(path)


def _replace(spark: SparkSession, path: str, schema: str, changes: DataFrame, merge, buckets: int) -> list[int]:
    """Put ``merge`` of the old rows and the changes in the place of the buckets that the changes touch; their numbers."""
    changes = settle(changes, "changes")
    touched = sorted(r[0] for r in changes.select("bucket").distinct().collect())  # at most the buckets there are
    if not touched:
        return []
    old = read(spark, path, schema).where(F.col("bucket").isin(touched))
    merged = settle(merge(old, changes), "merged")
    _write(merged, path, "overwrite")
    kept = {r[0] for r in merged.select("bucket").distinct().collect()}
    for b in touched:
        if b not in kept:  # a bucket without rows has no part in the overwrite
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return touched


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str, schema: str, *, buckets: int = BUCKETS, replaced: list[str] | None = None, first_wins: bool = False) -> list[int]:
    """Rows of ``new`` replace those of their keys or are added; the numbers of the rewritten buckets.

    ``replaced``: of known keys only these columns change, where the new value isn't null. ``first_wins``:
    known keys stay as they are. Rows with a null key go; of several new rows of a key one is taken.
    """
    columns = [f.name for f in new.schema]
    changes = new.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("bucket", _bucket(key, buckets))

    def merge(old: DataFrame, rows: DataFrame) -> DataFrame:
        a, b = old.alias("a"), rows.alias("b")
        known = F.col(f"a.{key}").isNotNull()
        take = lambda c: F.coalesce(f"b.{c}", f"a.{c}") if replaced is not None and c in replaced else F.when(known, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
        if first_wins or replaced is not None:
            pick = [take(c).alias(c) if not first_wins else F.when(known, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in columns]
        else:
            pick = [F.when(F.col(f"b.{key}").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in columns]
        return a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col(f"a.{key}") == F.col(f"b.{key}")), "full").select(*pick, F.coalesce("a.bucket", "b.bucket").alias("bucket"))

    return _replace(spark, path, schema, changes, merge, buckets)


def remove(spark: SparkSession, path: str, keys: DataFrame, key: str, schema: str, *, buckets: int = BUCKETS) -> list[int]:
    """The rows of ``keys`` go; the numbers of the rewritten buckets."""
    changes = keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn("bucket", _bucket(key, buckets))
    return _replace(spark, path, schema, changes, lambda old, gone: old.join(gone, ["bucket", key], "left_anti").select(*old.columns), buckets)
