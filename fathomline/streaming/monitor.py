"""Monitoring of a stream with state: the last rows of each service, their latency ranks, and the drift of vectors.

Each key's buffer is a list in the state store, so a restart goes on where the checkpoint ends. A task
first cuts what it has read of a micro-batch to the last rows of each key, so that of a busy service no
more than that from each task meets in one. After ``idle`` without rows a key's buffer is dropped and a
last row with no count tells so.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ranks(values: list[float]) -> tuple:
    """Count, mean, p50, p95, p99, maximum, as monitoring.nearest_rank() has them."""
    v = sorted(values)
    n = len(v)
    return n, round(float(np.mean(v)), 6), v[n // 2], v[int(n * 0.95)] if n > 20 else v[-1], v[int(n * 0.99)] if n > 100 else v[-1], v[-1]


def halves_drift(vectors: list, least: int = 10) -> float | None:
    """1 - cosine of the means of the first and the second half; None from too few."""
    if len(vectors) < least:
        return None
    x = np.array(vectors, np.float64)
    a, b = x[: len(x) // 2].mean(axis=0), x[len(x) // 2 :].mean(axis=0)
    size = np.sqrt(a @ a) * np.sqrt(b @ b)
    return round(float(1 - (a @ b / size if size else 0.0)), 6)


def last_of(frame: pd.DataFrame, n: int) -> pd.DataFrame:
    """The last ``n`` rows of each key by (at, id)."""
    return frame.sort_values(["at", "id"], kind="stable").groupby("key", sort=False).tail(n)


class _Buffer(StatefulProcessor):
    """Keeps the last ``n`` (at, id, value) of a key, in their order."""

    value_type, plain = "double", float

    def __init__(self, n: int, idle_ms: int | None):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", f"at timestamp, id long, value {self.value_type}")

    def told(self, key, values: list | None) -> pd.DataFrame:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {(r[0], r[1]): r[2] for r in self.rows.get()} if self.rows.exists() else {}
        for frame in rows:
            held.update({(a.to_pydatetime(), int(i)): self.plain(v) for a, i, v in zip(frame["at"], frame["id"], frame["value"], strict=True)})  # a row that comes again counts once
        kept = sorted(held)[-self.n :]
        self.rows.put([(a, i, held[a, i]) for a, i in kept])
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self.told(key[0], [held[k] for k in kept])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.rows.clear()
        yield self.told(key[0], None)

    def close(self) -> None:
        pass


class _Latencies(_Buffer):
    def told(self, key, values: list | None) -> pd.DataFrame:
        row = ranks(values) if values else (0, None, None, None, None, None)
        return pd.DataFrame([(key, *row)], columns=["service", "count", "mean", "p50", "p95", "p99", "max"])


class _Drift(_Buffer):
    value_type = "array<double>"

    @staticmethod
    def plain(v) -> list[float]:
        return [float(x) for x in v]

    def told(self, key, values: list | None) -> pd.DataFrame:
        drift = halves_drift([list(v) for v in values]) if values else None
        return pd.DataFrame({"service": [key], "count": [len(values or [])], "drift": pd.array([drift], dtype="Float64")})


def _rows(log: DataFrame, by: str, at: str, id_col: str, value: str, kind: str, n: int) -> DataFrame:
    rows = log.select(F.col(by).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(id_col).cast("long").alias("id"), F.col(value).cast(kind).alias("value")).dropna()

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            held = last_of(frame if held is None else pd.concat([held, frame]), n)
        if held is not None:
            yield held

    return rows.mapInPandas(each, rows.schema)


def latencies(log: DataFrame, *, by: str = "service", at: str = "ts", id_col: str = "id", value: str = "value", n: int = 1000, idle: float | None = None) -> DataFrame:
    """A stream of ``service``, ``count``, ``mean``, ``p50``, ``p95``, ``p99``, ``max`` over each service's last ``n`` rows, whenever some arrive.

    Rows with a null in any of the columns named go. ``idle``: seconds after which a service is
    forgotten; then a row with count 0 comes.
    """
    rows = _rows(log, by, at, id_col, value, "double", n)
    made = _Latencies(n, idle and int(idle * 1000))
    return rows.groupBy("key").transformWithStateInPandas(made, "service string, count long, mean double, p50 double, p95 double, p99 double, max double", "append", "ProcessingTime" if idle else "None")


def drifts(log: DataFrame, *, by: str = "service", at: str = "ts", id_col: str = "id", vector: str = "embedding", n: int = 100, idle: float | None = None) -> DataFrame:
    """A stream of ``service``, ``count``, ``drift`` between the halves of each service's last ``n`` vectors; null from under ten."""
    rows = _rows(log, by, at, id_col, vector, "array<double>", n)
    made = _Drift(n, idle and int(idle * 1000))
    return rows.groupBy("key").transformWithStateInPandas(made, "service string, count long, drift double", "append", "ProcessingTime" if idle else "None")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The store that lists in state need, for queries started meanwhile; the session's setting comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def run_once(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Process what is there and stop; rows are appended to ``folder`` with the number of their micro-batch."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")  # a batch that is tried again replaces itself

    with state_store(stream.sparkSession):
        stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Of each service the row of its last micro-batch."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(folder)
    return rows.groupBy("service").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("service", "batch")]), "batch").alias("r")).select("service", "r.*")
