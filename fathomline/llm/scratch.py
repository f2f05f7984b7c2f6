"""Slices of Arrow batches, whole groups of a sorted stream and id filters that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import scratch
from ..sources.scratch import BATCH, BATCH_BYTES, shared_root

__all__ = ["BATCH", "BATCH_BYTES", "BROADCAST_IDS", "group_ends", "new_folder", "only", "settle", "settle_numbers", "small", "texts_of", "whole_groups", "without"]

#: Rows and bytes of a slice of whole texts; Spark bounds the bytes of the batch that it is cut from.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 22

def settle(df: DataFrame, name: str) -> DataFrame:
    """sources.scratch.settle with smaller Arrow batches while it writes; the session's setting comes back after."""
    return scratch.settle(df, name, small=True)


def settle_numbers(df: DataFrame, name: str) -> DataFrame:
    """The same for one whose Python functions get a few numbers a row, no texts or lists."""
    return scratch.settle(df, name, small=True, size=scratch.ROWS_ALONE)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/fathomline/{name}-{uuid.uuid4().hex}"


def small(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut into slices that Python can expand; one very long text is a slice of its own at most."""
    for b in batches:
        step = max(1, min(rows, b.num_rows * size // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def _changes(b: pa.RecordBatch | pa.Table, keys: Sequence[str]) -> np.ndarray:
    change = np.zeros(max(0, b.num_rows - 1), bool)
    for k in keys:
        c = b.column(k)
        change |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False), bool) if len(c) > 1 else False
    return np.flatnonzero(change) + 1


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Of a stream that is sorted by ``keys`` (without nulls): tables that hold each of their groups whole."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if held and any(held[-1].column(k)[-1] != b.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        cuts = _changes(b, keys)
        if len(cuts):
            yield pa.Table.from_batches([*held, b.slice(0, int(cuts[-1]))])
            held = [b.slice(int(cuts[-1]))]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def group_ends(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Row numbers at which the groups of a sorted table start, and the number of rows."""
    return np.concatenate(([0], _changes(table, keys), [table.num_rows]))


#: Ids in a broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def only(docs: DataFrame, ids: DataFrame, id_col: str, how: str = "left_semi") -> DataFrame:
    """``docs`` with (``left_anti``: without) the ids in the one column of the settled table ``ids``.

    Whole texts are shuffled only where the ids are too many to broadcast.
    """
    key = ids.toDF("_only_id")
    if key.count() <= BROADCAST_IDS:
        key = F.broadcast(key)
    return docs.join(key, docs[id_col] == key["_only_id"], how)


def texts_of(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Of rows (id, text) without nulls: each different text of an id as (id, copy, text), and for the ids with several rows (id, mark, copy).

    ``copy`` numbers the texts of an id by their SHA-256, ``mark``; without such ids it is 0 throughout.
    """
    several = settle(rows.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"), "several")
    if several.isEmpty():
        return rows.select("id", F.lit(0).alias("copy"), "text"), None
    apart = settle(only(rows, several, "id").withColumn("mark", F.unhex(F.sha2("text", 256))).dropDuplicates(["id", "mark"]), "apart")
    numbers = apart.select("id", "mark", (F.row_number().over(Window.partitionBy("id").orderBy("mark")) - 1).alias("copy"))
    numbers = settle(numbers, "numbers")
    single = only(rows, several, "id", "left_anti").select("id", F.lit(0).alias("copy"), "text")
    return single.unionByName(apart.join(numbers, ["id", "mark"]).select("id", "copy", "text")), numbers


def without(texts: DataFrame, gone: DataFrame) -> DataFrame:
    """``texts`` but for those whose (id, copy) is in the settled table ``gone``; broadcast where it is small."""
    gone = gone.select("id", "copy")
    return texts.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, ["id", "copy"], "left_anti")
