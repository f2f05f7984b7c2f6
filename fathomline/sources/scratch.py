"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset on one machine (tests), a new temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="fathomline-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Lists that take note of the tables written meanwhile.
_notes: list[list[str]] = []


@contextmanager
def noted() -> Iterator[list[str]]:
    """The folders of all tables that are settled meanwhile, for drop() when nothing reads them any more."""
    made: list[str] = []
    _notes.append(made)
    try:
        yield made
    finally:
        _notes[:] = [n for n in _notes if n is not made]


def drop(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete settled tables, wherever Spark can write; a DataFrame that still reads one fails."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Bytes of the Arrow batches of a table that an operator writes; an executor holds several of them.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: No limit but that of rows: Spark then doesn't add up the columns' bytes after each row, which takes longer than to write a row of numbers.
ROWS_ALONE = (1 << 31) - 1


@contextmanager
def smaller_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Arrow batches of ``size`` bytes meanwhile; the session's setting comes back after."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH)
        else:
            spark.conf.set(BATCH, before)


def settle(df: DataFrame, name: str, *, small: bool = False, size: int = BATCH_BYTES) -> DataFrame:
    """Write ``df`` once and read it back: a lost executor costs the tasks that read it, nothing above. ``small``: by smaller_batches() of ``size``."""
    path = f"{shared_root(df.sparkSession)}/fathomline/{name}-{uuid.uuid4().hex}"
    with smaller_batches(df.sparkSession, size) if small else nullcontext():
        df.write.parquet(path)
    for made in _notes:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table in a broadcast at most.
BROADCAST_ROWS = 500_000


def lookup(df: DataFrame, name: str) -> DataFrame:
    """A settled table for a join with a larger one: broadcast if it is counted as small, else merged.

    Kept tables of words take few bytes on disk and many in memory, so that Spark may take the
    larger side for the smaller one and send that to the driver; the hint says which it is.
    """
    made = settle(df, name)
    return F.broadcast(made) if made.count() <= BROADCAST_ROWS else made.hint("merge")
