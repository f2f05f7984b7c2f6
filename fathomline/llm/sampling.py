"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import settle


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """Rows ``(key, label)``, about ``most`` at most, chosen by a hash of the id; labels other than 0 and 1 go.

    An id with both labels goes too.
    """
    rows = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label")).where("key is not null and label in (0, 1)")
    rows = rows.groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top").drop("top")
    rows = settle(rows, "labels")
    share = min(1.0, most / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 50)) < F.lit(round(share * (1 << 50))))
