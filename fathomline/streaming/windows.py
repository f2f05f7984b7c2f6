"""Event-time windows over a log, the same for a batch and a stream.

An extension: there are no streams to match, so it is held against the batch result in tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New parquet files of ``folder`` as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def _counted(log: DataFrame, span: Column, late: str) -> DataFrame:
    rows = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", F.round("total", 4).alias("total"))


def tumbling(log: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return _counted(log, F.window("ts", size), late)


def sliding(log: DataFrame, size: str = "10 minutes", step: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return _counted(log, F.window("ts", size, step), late)


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a user's events with no gap of ``gap`` or more."""
    rows = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_once(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Process what is there, append the windows that are closed, and stop."""
    stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
