"""Embedding near-duplicates: sign hashes of random hyperplanes, exact cosines, connected components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .scratch import BROADCAST_IDS, group_ends, settle, small, whole_groups

SEED = 20_240_607
#: Vectors in a bucket, about: the larger, the fewer tables, and so the fewer copies of a vector, are needed.
BUCKET = 1024
#: Vectors of a block: larger buckets are cut into blocks, and each task compares two of them.
BLOCK = 2048
_KEYS = ("t", "dims", "code", "lo", "hi")


def tables_for(n: int, cosine: float, recall: float, bucket: int = BUCKET) -> tuple[int, int]:
    """(bits, tables): buckets of about ``bucket`` of ``n`` spread vectors, and so many tables that a pair just
    at the threshold shares a bucket with probability ``recall``. A plane splits a pair at angle a
    with probability a / pi."""
    bits = min(62, max(4, math.ceil(math.log2(max(n, 1) / bucket + 1))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log1p(-agree))


def code_type(bits: int) -> str:
    """The least unsigned integer that holds a code."""
    return f"<u{next(w for w in (1, 2, 4, 8) if bits <= 8 * w)}"


@lru_cache(maxsize=8)
def _planes(dims: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, dims]).standard_normal((dims, count))


def _prepared(vectors: DataFrame) -> DataFrame:
    """``id``, ``mark``, ``dims``, ``vec``: a digest of the numbers, null for vectors that link with nothing; and their bytes."""
    single = vectors.schema["vec"].dataType.simpleString() == "array<float>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 2048):
            marks, data, dims = [], [], []
            for v in b.column(1):
                x = None if not v.is_valid or v.values.null_count else np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) + 0.0
                good = x is not None and np.isfinite(x).all() and x.any()
                marks.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if good else None)
                data.append(x.astype("<f4" if single else "<f8").tobytes() if good else None)
                dims.append(len(x) if good else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks, pa.binary()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], ["id", "mark", "dims", "vec"])

    return vectors.mapInArrow(each, f"id {vectors.schema['id'].dataType.simpleString()}, mark binary, dims int, vec binary")


def _unpacked(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of doubles, each scaled by its largest number, so that no square over- or underflows."""
    data = b"".join(column.to_pylist())
    x = np.frombuffer(data, f"<f{len(data) // (len(column) * dims)}").reshape(len(column), dims).astype(np.float64)
    return x / np.abs(x).max(axis=1, keepdims=True)


def _coded(heads: DataFrame, bits: int, tables: int) -> DataFrame:
    """``mark``, ``dims`` and the bytes of one code for each table."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        for b in small(batches, 2048):
            sizes, packed = b.column(1).to_numpy(), np.empty(b.num_rows, object)
            for dims in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dims)
                signs = _unpacked(b.column(2).take(pa.array(at)), dims) @ _planes(dims, bits * tables) > 0
                codes = (signs.reshape(len(at), tables, bits) * powers).sum(axis=2, dtype=np.uint64).astype(code_type(bits))
                for i, c in zip(at, codes, strict=True):
                    packed[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["mark", "dims", "codes"])

    return heads.select("mark", "dims", "vec").mapInArrow(each, "mark binary, dims int, codes binary")


def compare(a: np.ndarray, b: np.ndarray, codes_a: np.ndarray, codes_b: np.ndarray, t: int, cosine: float) -> np.ndarray:
    """Which pairs reach the cosine and share a bucket in table ``t`` but in no earlier one."""
    for u in range(t):  # often all of a block, as copies do
        if codes_a[0, u] == codes_b[0, u] and (codes_a[:, u] == codes_a[0, u]).all() and (codes_b[:, u] == codes_b[0, u]).all():
            return np.zeros((len(a), len(b)), bool)
    linked = a @ b.T >= cosine
    for u in range(t):
        if not linked.any():
            break
        linked &= codes_a[:, u, None] != codes_b[None, :, u]
    return linked


def _local_roots(linked: np.ndarray) -> np.ndarray:
    """For a symmetric relation: the number of the first row that each row reaches."""
    n = len(linked)
    root, reach = np.arange(n, dtype=np.int32), linked | np.eye(n, dtype=bool)
    while True:
        new = np.where(reach, root[None, :], np.int32(n)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _links(members: DataFrame, cosine: float, kind: str) -> DataFrame:
    """``mark``, ``links`` (vectors linked with it), ``root``, for each vector with links in a pair of blocks."""

    def group(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        t, size = rows["t"][0].as_py(), rows.num_rows
        x = _unpacked(rows["vec"], rows["dims"][0].as_py())
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), kind).reshape(size, -1)
        copies, side = rows["copies"].to_numpy(), rows["side"].to_numpy()
        linked = np.zeros((size, size), bool)
        if rows["lo"][0] == rows["hi"][0]:
            linked = compare(x, x, codes, codes, t, cosine)
            np.fill_diagonal(linked, False)
        else:
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if len(a) and len(b):
                linked[np.ix_(a, b)] = compare(x[a], x[b], codes[a], codes[b], t, cosine)
                linked |= linked.T
        if not linked.any():
            return None
        counts = linked @ copies
        at = np.flatnonzero(counts)
        return at, counts[at], _local_roots(linked)[at]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, _KEYS):
            ends, marks, found = group_ends(table, _KEYS), table["mark"].combine_chunks(), []
            for lo, hi in zip(ends.tolist(), ends[1:].tolist(), strict=False):
                if hi - lo > 1 and (made := group(table.slice(lo, hi - lo))):
                    found.append((made[0] + lo, made[1], made[2] + lo))
            if found:
                at, counts, roots = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([marks.take(pa.array(at)), pa.array(counts, pa.int64()), marks.take(pa.array(roots))], ["mark", "links", "root"])

    rows = members.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "mark")
    return rows.mapInArrow(each, "mark binary, links long, root binary")


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, recall: float = 0.99, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """One row ``(id, n_links, component_id, kept)`` for each input row.

    Vectors whose cosine, in doubles, is at least ``cosine`` are linked if they share a bucket of one
    table, which such a pair does with probability ``recall`` at least; no other pair is linked.
    Equal vectors are one class with a count and are always linked. Large buckets are cut into blocks
    of about ``block`` vectors, whose pairs are compared as matrices: pairs never become rows, and
    each is counted in the first table that holds it. Vectors that are null, zero or have null or
    non-finite components link with nothing, nor do vectors of different length. Rows that repeat an
    id and vector keep their rows and count once; different vectors of one id are vectors of their
    own, which may link with each other. A null id has no links and a null component. Other columns
    are ignored. An empty table gives an empty result.
    """
    rows = settle(_prepared(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"))), "vectors")
    good = rows.where("mark is not null and id is not null")
    classes = settle(good.select("id", "mark").distinct().groupBy("mark").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "classes")
    # A vector of each class; only those of repeated ones move.
    repeated = settle(good.groupBy("mark").agg(F.count("*").alias("rows")).where("rows > 1").select("mark"), "repeated")
    known = F.broadcast(repeated) if repeated.count() <= BROADCAST_IDS else repeated
    heads = good.join(known, "mark", "left_anti").unionByName(good.join(known, "mark", "left_semi").dropDuplicates(["mark"])).select("mark", "dims", "vec")
    heads = settle(heads, "heads")
    bits, tables = tables_for(heads.count(), cosine, recall, bucket)
    coded = settle(_coded(heads, bits, tables), "codes")
    kind = code_type(bits)
    width = int(kind[2:])
    code = F.array(*[F.substring("codes", 1 + width * t, width) for t in range(tables)])
    keyed = coded.select("mark", "dims", F.posexplode(code).alias("t", "code"))
    shared = keyed.groupBy("t", "dims", "code").agg(F.count("*").alias("n")).where("n > 1")
    placed = keyed.join(settle(shared, "buckets"), ["t", "dims", "code"]).withColumn("blocks", F.ceil(F.col("n") / F.lit(block)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("mark", "t"), F.col("blocks")))
    placed = placed.select("mark", "t", "code", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("mark", "t", "code", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("side"))
    held = heads.join(coded.select("mark", "codes"), "mark").join(classes.select("mark", "copies"), "mark")
    links = settle(_links(placed.join(settle(held, "held"), "mark"), cosine, kind), "links")
    found = connected_components(links, "mark", "root")
    counts = links.groupBy("mark").agg(F.sum("links").alias("links"))
    nodes = settle(classes.join(counts, "mark", "left").join(found.withColumnRenamed("node", "mark"), "mark", "left").withColumn("component", F.coalesce("component", "mark")), "nodes")
    least = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    nodes = nodes.join(least, "component").select("mark", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("id", F.when(F.col("id").isNotNull(), F.col("mark")).alias("mark")).join(nodes, "mark", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
