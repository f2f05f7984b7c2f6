"""Blocks of a stated query set against blocks of all rows, each pair of blocks in one task."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of query blocks that meet the other side at once: broadcast if they are all, else one cell of the grid.
QUERY_BYTES = 16 << 20
#: Bytes of the other side's blocks in a cell of the grid, about.
ROW_BYTES = 256 << 20


def against(blocks: DataFrame, queries: DataFrame, size: int, query_size: int) -> DataFrame:
    """Each block of ``blocks`` beside each of ``queries``; both tables are settled, of ``size`` and ``query_size`` bytes.

    Few bytes of queries are broadcast. More of them are cut into parts, and so are the blocks; each
    pair of parts is one key of a join, so that a side moves once for each part of the other.
    """
    if query_size <= QUERY_BYTES:
        return blocks.crossJoin(F.broadcast(queries))
    parts, rows = math.ceil(query_size / QUERY_BYTES), math.ceil(size / ROW_BYTES)
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = blocks.withColumn("_row", F.pmod(F.monotonically_increasing_id(), F.lit(rows)).cast("int")).withColumn("_part", span(parts))
    b = queries.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")).withColumn("_row", span(rows))
    return a.join(b, ["_row", "_part"]).drop("_row", "_part")


def ranked_first(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` of each row number, by falling score, then rising id; in that order."""
    order = np.lexsort((ids, -scores, rows))
    at = rows[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return order[place < k]


class Best:
    """The ``k`` best (score, id) of each of ``n`` lists, over all blocks that a task has seen."""

    def __init__(self, n: int, k: int, kind: type):
        self.n, self.k = n, k
        self.rows, self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64)
        self.least = np.full(n, -np.inf)

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> None:
        """Scores of rows ``ids`` (columns) for some lists, where ``mask`` holds."""
        cut = self.least[lists]
        s = np.where(mask, scores, -np.inf)
        if s.shape[1] > self.k:
            cut = np.maximum(cut, np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k])
        r, c = np.nonzero(mask & (s >= cut[:, None]))
        if not len(r):
            return
        rows, new, ids = np.concatenate((self.rows, lists[r])), np.concatenate((self.scores, scores[r, c].astype(self.scores.dtype))), np.concatenate((self.ids, ids[c]))
        keep = ranked_first(rows, new, ids, self.k)
        self.rows, self.scores, self.ids = rows[keep], new[keep], ids[keep]
        full = np.bincount(self.rows, minlength=self.n) == self.k
        last = np.cumsum(np.bincount(self.rows, minlength=self.n)) - 1
        self.least[full] = self.scores[last[full]]
