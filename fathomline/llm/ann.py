"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, results merged.

A shard is one row of a table: its vectors and, for each level, the neighbours of its nodes as one
flat array of numbers. Levels fall by a hash, and nodes lie in the order of their level, so each
level is a prefix of the nodes. Each node is linked with diverse ones of its nearest earlier nodes,
which are found exactly, by matrix products within the shard, and those link back. Equal vectors are
one node with several ids.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import top_k
from .grid import against
from .scratch import BROADCAST_IDS, group_ends, settle, small, whole_groups

#: Links of a node on the upper levels; the lowest has twice as many. Candidates that links are chosen from. Nodes that a search keeps.
LINKS, CANDIDATES, BREADTH = 16, 64, 96
#: Queries in a block.
QUERIES = 512
#: Vectors of a shard: this many times the root of all, and at most so many.
SHARD_ROOTS, SHARD_MOST = 8, 1 << 16


def shards_for(n: int) -> int:
    """Shards for ``n`` vectors: larger ones cost more to build (their square), more of them cost each query a search."""
    return max(1, math.ceil(n / min(SHARD_MOST, SHARD_ROOTS * math.sqrt(max(n, 1)))))


def _prepared(vectors: DataFrame) -> DataFrame:
    """``id``, ``mark`` (a digest of the numbers), ``dims``, ``vec`` (their bytes as doubles) of the rows that take part."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 2048):
            marks, data, dims = [], [], []
            for v in b.column(1):
                x = None if not v.is_valid or v.values.null_count else np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) + 0.0
                good = x is not None and np.isfinite(x).all() and x.any()
                marks.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if good else None)
                data.append(x.tobytes() if good else None)
                dims.append(len(x) if good else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks, pa.binary()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], ["id", "mark", "dims", "vec"])

    return vectors.mapInArrow(each, "id long, mark binary, dims int, vec binary").where("mark is not null and id is not null")


def diverse(near: np.ndarray, between: np.ndarray, valid: np.ndarray, most: int) -> np.ndarray:
    """Which candidates to link: nearer to the node than to all that were taken before them, then the nearest others.

    ``near``: distances of each row's candidates, rising; ``between``: those among them.
    """
    rows, width = near.shape
    taken, counts = np.zeros((rows, width), bool), np.zeros(rows, np.int64)
    for c in range(width):
        ok = valid[:, c] & (counts < most) & ~(taken[:, :c] & (between[:, c, :c] < near[:, c, None])).any(axis=1)
        taken[:, c] = ok
        counts += ok
    spare = valid & ~taken
    return taken | spare & (np.cumsum(spare, axis=1) <= (most - counts)[:, None])


def _links(x: np.ndarray, node: np.ndarray, candidates: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each node's candidates (numbers, -1 for none, by rising distance): the linked ones, -1 for the rest, in ``most`` columns."""
    out = np.full((len(node), most), -1, np.int32)
    for at in range(0, len(node), 256):
        c, d = candidates[at : at + 256], near[at : at + 256]
        v = x[np.maximum(c, 0)]
        squares = (v * v).sum(axis=2)
        between = squares[:, :, None] + squares[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
        kept = diverse(d, between, c >= 0, most)
        order = np.argsort(~kept, axis=1, kind="stable")[:, :most]
        out[at : at + 256, : order.shape[1]] = np.where(np.take_along_axis(kept, order, 1), np.take_along_axis(c, order, 1), -1)
    return out


def level_graph(x: np.ndarray, links: int, most: int, candidates: int) -> np.ndarray:
    """Neighbours of each node, ``most`` columns, -1 for none: ``links`` of its nearest earlier nodes, and those that chose it."""
    n, squares = len(x), (x * x).sum(axis=1)
    chosen, dist = np.full((n, links), -1, np.int32), np.full((n, links), np.inf)
    for lo in range(0, n, 1024):
        hi = min(n, lo + 1024)
        d = squares[lo:hi, None] + squares[None, :hi] - 2 * (x[lo:hi] @ x[:hi].T)
        d[np.arange(lo, hi)[:, None] <= np.arange(hi)[None]] = np.inf  # earlier nodes alone
        width = min(candidates, hi)
        near = np.argpartition(d, width - 1, axis=1)[:, :width]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
        at = np.take_along_axis(d, near, 1)
        chosen[lo:hi] = _links(x, np.arange(lo, hi), np.where(np.isfinite(at), near, -1), at, links)
    rows, columns = np.nonzero(chosen >= 0)
    a, b = np.concatenate((rows, chosen[rows, columns])), np.concatenate((chosen[rows, columns], rows))
    gap = ((x[a] - x[b]) ** 2).sum(axis=1)
    order = np.lexsort((b, gap, a))
    a, b, gap = a[order], b[order], gap[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    width = min(max(2 * candidates, most), int(place.max(initial=0)) + 1)  # of a hub's links the nearest are looked at
    table, dist = np.full((n, width), -1, np.int32), np.full((n, width), np.inf)
    ok = place < width
    table[a[ok], place[ok]], dist[a[ok], place[ok]] = b[ok], gap[ok]
    if width <= most:
        return np.pad(table, ((0, 0), (0, most - width)), constant_values=-1)
    return _links(x, np.arange(n), table, dist, most)


@dataclass
class Graph:
    """Vectors, the neighbours of each level (the lowest first; a level is a prefix of the nodes), and nodes that no walk reaches."""

    x: np.ndarray
    levels: list[np.ndarray]
    loose: np.ndarray

    @classmethod
    def build(cls, x: np.ndarray, heights: np.ndarray, links: int = LINKS, candidates: int = CANDIDATES) -> Graph:
        """``heights``: the level of each node, falling."""
        levels = [level_graph(x[: int((heights >= h).sum())], links, 2 * links if h == 0 else links, candidates) for h in range(int(heights[0]) + 1)]
        seen, front = np.zeros(len(x), bool), np.zeros(1, np.int64)
        seen[0] = True
        while len(front):
            front = np.unique(levels[0][front])
            front = front[front >= 0]
            front = front[~seen[front]]
            seen[front] = True
        return cls(x, levels, np.flatnonzero(~seen))

    def walk(self, q: np.ndarray, starts: np.ndarray, level: int, breadth: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and squared distances, by rising distance, that each query's beam ends with; -1 for none."""
        rows, n, edges = len(q), len(self.levels[level]), self.levels[level]
        squares = (self.x * self.x).sum(axis=1)
        own = (q * q).sum(axis=1)[:, None]
        away = lambda c: own + squares[c] - 2 * np.einsum("bd,bmd->bm", q, self.x[c])
        ids = np.full((rows, breadth), -1, np.int64)
        ids[:, : starts.shape[1]] = starts
        dist = np.where(ids >= 0, away(np.maximum(ids, 0)), np.inf)
        done, seen = ids < 0, np.zeros((rows, n), bool)
        line = np.arange(rows)[:, None]
        seen[line, starts] = True
        active = np.arange(rows)
        while len(active):
            d = np.where(done[active], np.inf, dist[active])
            pick = np.argsort(d, axis=1, kind="stable")[:, :step]
            open_ = np.take_along_axis(np.isfinite(d), pick, 1)
            go = open_.any(axis=1)
            active, pick, open_ = active[go], pick[go], open_[go]
            if not len(active):
                break
            at = active[:, None]
            done[at, pick] = True
            new = np.where(open_[:, :, None], edges[np.maximum(ids[at, pick], 0)], -1).reshape(len(active), -1).astype(np.int64)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[(new >= 0) & seen[at, np.maximum(new, 0)]] = -1
            r, c = np.nonzero(new >= 0)
            seen[active[r], new[r, c]] = True
            gap = np.full(new.shape, np.inf)
            found = new[r, c]
            gap[r, c] = own[active[r], 0] + squares[found] - 2 * np.einsum("md,md->m", q[active[r]], self.x[found])
            every, all_ids = np.concatenate((dist[active], gap), axis=1), np.concatenate((ids[active], new), axis=1)
            was = np.concatenate((done[active], new < 0), axis=1)
            order = np.argsort(every, axis=1, kind="stable")[:, :breadth]
            dist[active], ids[active], done[active] = (np.take_along_axis(v, order, 1) for v in (every, all_ids, was))
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)

    def search(self, q: np.ndarray, breadth: int) -> np.ndarray:
        """Nodes near each query, -1 for none: down the levels, then a beam; and all nodes that no walk reaches."""
        starts = np.zeros((len(q), 1), np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            starts = self.walk(q, starts, level, 4, 1)[0][:, :1]
        found = self.walk(q, starts, 0, breadth)[0]
        return np.concatenate((found, np.broadcast_to(self.loose, (len(q), len(self.loose)))), axis=1) if len(self.loose) else found


def exact_distance(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in doubles, summed in the order of the components; those whose squares overflow are scaled first."""
    total = np.zeros(np.broadcast_shapes(q.shape, x.shape)[:-1])
    with np.errstate(over="ignore"):
        gap = q - x
        for k in range(gap.shape[-1]):
            total += gap[..., k] * gap[..., k]
    out = np.sqrt(total)
    if not np.isfinite(out).all():
        wide = np.abs(q / 4 - x / 4).max(axis=-1)
        scaled = np.sqrt((((q / 4 - x / 4) / np.where(wide > 0, wide, 1)[..., None]) ** 2).sum(axis=-1)) * wide
        with np.errstate(over="ignore"):
            out = np.where(np.isfinite(out), out, scaled * 4)
    return out


def _heights(marks: list[bytes], links: int) -> np.ndarray:
    draws = (np.array([int.from_bytes(m[:6], "little") for m in marks]) + 1) / (1 << 48)
    return np.minimum(np.floor(-np.log(draws) / math.log(links)), 12).astype(np.int64)


def build_index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", copies: int = 11, links: int = LINKS, candidates: int = CANDIDATES) -> DataFrame:
    """A settled table with one row a shard: ``dims``, ``nodes``, ``x``, ``ids`` and their ``ends``, ``sizes`` of levels, ``edges``, ``loose``.

    Every vector is a node of one shard. A node keeps the least ``copies`` ids of its vector: a search
    for k neighbours can return no more than k + 1 of them (with the query's own), as they tie and
    lesser ids come first. Rows with a null id or a null, empty or zero vector, or one with null or
    non-finite components are left out. Vectors of different length are in different shards.
    """
    rows = settle(_prepared(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec")).where("vec is not null")), "vectors")
    repeated = settle(rows.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"), "repeated")
    if not repeated.isEmpty():
        known = F.broadcast(repeated) if repeated.count() <= BROADCAST_IDS else repeated
        held = rows.join(known, "mark", "left_semi").dropDuplicates(["mark", "id"])
        some = top_k(held.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16))), ["mark", "salt"], [F.asc("id")], copies).drop("salt", "rank")  # a vector may hold most rows
        rows = settle(rows.join(known, "mark", "left_anti").unionByName(top_k(some, ["mark"], [F.asc("id")], copies).drop("rank")), "classes")
    count = rows.select("mark").distinct().count() if not repeated.isEmpty() else rows.count()
    shards = shards_for(count)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("dims", "shard")):
            ends = group_ends(table, ("dims", "shard"))
            for lo, hi in zip(ends.tolist(), ends[1:].tolist(), strict=False):
                yield _packed(table.slice(lo, hi - lo), links, candidates)

    placed = rows.withColumn("shard", F.pmod(F.xxhash64("mark"), F.lit(shards)).cast("int"))
    placed = placed.repartition("dims", "shard").sortWithinPartitions("dims", "shard", "mark", "id")
    return settle(placed.mapInArrow(each, "dims int, nodes int, x binary, ids binary, ends binary, sizes binary, edges binary, loose binary"), "index")


def _packed(rows: pa.Table, links: int, candidates: int) -> pa.RecordBatch:
    """The graph of one shard, whose rows are sorted by vector and id, as a row of flat arrays."""
    starts, ids = group_ends(rows, ("mark",)), rows["id"].to_numpy()
    heads = rows.take(pa.array(starts[:-1]))
    heights = _heights(heads["mark"].to_pylist(), links)
    order = np.argsort(-heights, kind="stable")
    x = np.frombuffer(b"".join(heads["vec"].to_pylist())).reshape(len(order), -1)[order]
    scale = np.abs(x).max()
    graph = Graph.build(x / scale, heights[order], links, candidates)
    counts = np.diff(starts)[order]
    flat = np.concatenate([ids[starts[k] : starts[k + 1]] for k in order])
    data = [x, flat.astype("<i8"), np.concatenate(([0], np.cumsum(counts))).astype("<i8"), np.array([len(g) for g in graph.levels], "<i4"), np.concatenate([g.ravel() for g in graph.levels]).astype("<i4"), graph.loose.astype("<i4")]
    names = ["dims", "nodes", "x", "ids", "ends", "sizes", "edges", "loose"]
    return pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([len(x)], pa.int32()), *(pa.array([d.tobytes()], pa.binary()) for d in data)], names)


def _query_blocks(queries: DataFrame) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, QUERIES, 1 << 62):
            dims = b.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                part = b.take(pa.array(np.flatnonzero(dims == d)))
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([b"".join(part.column(3).to_pylist())], pa.binary())], ["q_dims", "q_ids", "q"])

    return queries.mapInArrow(each, "q_dims int, q_ids binary, q binary")


def search_index(index: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", breadth: int = BREADTH, links: int = LINKS) -> DataFrame:
    """``query_id``, ``vec_id``, ``score`` (the Euclidean distance), ``rank``: of each query the ``k`` nearest that the graphs find.

    Every query walks each shard's graph; the nodes of its last beam are measured again on the given
    vectors, in doubles, and the best of all shards stay, ties by the lesser id. A query's own id is
    left out. Queries with a null id or a null, empty, zero or non-finite vector have no rows; those
    that repeat an id and vector count once, and different vectors of an id give rows under that id.
    """
    given = _prepared(queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec")).where("vec is not null"))
    asked = settle(_query_blocks(given.dropDuplicates(["id", "mark"])).withColumn("q_no", F.monotonically_increasing_id()), "queries")

    def one(row: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        get = lambda c, kind: np.frombuffer(row[c][0].as_buffer(), kind)
        dims = row["dims"][0].as_py()
        x, q, ids, q_ids, ends = get("x", "<f8").reshape(-1, dims), get("q", "<f8").reshape(-1, dims), get("ids", "<i8"), get("q_ids", "<i8"), get("ends", "<i8")
        scale, levels, at = np.abs(x).max(), [], 0
        for level, n in enumerate(get("sizes", "<i4").tolist()):
            width = 2 * links if level == 0 else links
            levels.append(get("edges", "<i4")[at : at + n * width].reshape(n, width))
            at += n * width
        with np.errstate(over="ignore", invalid="ignore"):
            found = Graph(x / scale, levels, get("loose", "<i4")).search(np.clip(q / scale, -1e100, 1e100), breadth)
        r, c = np.nonzero(found >= 0)
        node = found[r, c]
        score = exact_distance(q[r], x[node])
        counts = ends[node + 1] - ends[node]
        r, score = np.repeat(r, counts), np.repeat(score, counts)
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        other = ids[np.repeat(ends[node], counts) + inner]
        keep = other != q_ids[r]
        r, score, other = r[keep], score[keep], other[keep]
        order = np.lexsort((other, score, r))
        r, score, other = r[order], score[order], other[order]
        first = (np.arange(len(r)) - np.searchsorted(r, r)) < k
        return r[first], q_ids[r[first]], other[first], score[first]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                row = b.slice(at, 1)
                if row["dims"][0] == row["q_dims"][0]:
                    no, query, other, score = one(row)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(no), row["q_no"][0].as_py())), pa.array(no), pa.array(query), pa.array(other), pa.array(score)], ["q_no", "at", "query_id", "vec_id", "score"])

    size = index.agg(F.sum(F.octet_length("x") + F.octet_length("edges"))).first()[0] or 0
    asked_size = asked.agg(F.sum(F.octet_length("q"))).first()[0] or 0
    pairs = against(index, asked, size, asked_size).mapInArrow(each, "q_no long, at long, query_id long, vec_id long, score double")
    return top_k(pairs, ["q_no", "at"], [F.asc("score"), F.asc("vec_id")], k).select("query_id", "vec_id", "score", "rank")


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding", breadth: int = BREADTH) -> DataFrame:
    """build_index() over ``vectors``, then search_index() for ``queries``; an empty table on either side gives no rows."""
    index = build_index(vectors, id_col=id_col, vector_col=vector_col, copies=k + 1)
    return search_index(index, queries, k, id_col=id_col, vector_col=vector_col, breadth=breadth)
