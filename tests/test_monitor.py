"""The stream's state against the batch forms, across a restart, and its time-out."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fathomline.operators import monitoring
from fathomline.streaming import monitor

LATENCY = "service string, count long, mean double, p50 double, p95 double, p99 double, max double"


def shown(df):
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.fixture
def parts(spark, sf, tmp_path):
    """Events in files, in an order that isn't that of time."""
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("service"), F.col("event_id").alias("id"), "ts", "value")
    for k in range(4):
        events.where(F.pmod(F.xxhash64("id"), F.lit(4)) == k).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    return events


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def put(tmp_path, k):
    (tmp_path / "in").mkdir(exist_ok=True)
    for f in (tmp_path / f"part{k}").glob("part-*.parquet"):
        f.rename(tmp_path / "in" / f"{k}.parquet")


def test_latencies_go_on_after_a_restart(spark, parts, tmp_path):
    n = 150
    for k in (0, 1):
        put(tmp_path, k)
    run = lambda: monitor.run_once(monitor.latencies(stream(spark, tmp_path / "in", parts.schema), n=n), str(tmp_path / "out"), str(tmp_path / "check"))
    run()
    for k in (2, 3):
        put(tmp_path, k)
    run()
    want = monitoring.nearest_rank(monitoring.last_n(parts, ["service"], [F.desc("ts"), F.desc("id")], n), "service", "value")
    got = monitor.latest(spark, str(tmp_path / "out"), LATENCY)
    assert shown(got) == shown(want.select(*got.columns))
    assert got.where(f"count = {n}").count() > 0
    assert spark.conf.get(monitor.PROVIDER, None) != monitor.ROCKSDB


def test_drift_of_the_last_vectors(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.lit("all").alias("service"), F.col("vec_id").alias("id"), F.timestamp_seconds("vec_id").alias("ts"), "embedding")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    monitor.run_once(monitor.drifts(stream(spark, tmp_path / "in", rows.schema)), str(tmp_path / "out"), str(tmp_path / "check"))
    got = monitor.latest(spark, str(tmp_path / "out"), "service string, count long, drift double").first()
    assert (got["count"], got["drift"]) == (100, pytest.approx(monitoring.sample_drift(rows, "id").first()["drift"], abs=2e-6))


def test_an_idle_service_is_forgotten(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 7.0), (None, 3, 1.0)], "service string, id long, value double").withColumn("ts", F.timestamp_seconds("id"))
    (tmp_path / "in").mkdir()
    rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = []
    made = monitor.latencies(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), idle=2)
    with monitor.state_store(spark):
        query = made.writeStream.outputMode("append").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
        end = time.time() + 90
        while time.time() < end and query.isActive and not any(r["count"] == 0 for r in out):
            time.sleep(0.5)
        query.stop()
    assert [(r["service"], r["count"], r["max"]) for r in out] == [("a", 2, 7.0), ("a", 0, None)]
