"""Near copies by the share of word shingles: candidates from MinHash bands, verified exactly.

A band of ``rows`` minima is equal in two texts of similarity s with chance s^rows. Members of a band's
bucket are compared with the least and the greatest of them first; then those that this leaves apart, each
with all members of its bucket's other groups, so that the groups are those of all pairs of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .scratch import BROADCAST_IDS, only, settle, small, texts_of
from .simhash import BLOCK, SEED, WORD

WIDTH, SIMILARITY = 5, 0.8
#: At a similarity of 0.8, a pair meets in one of 20 bands of 5 with a chance of 0.9996.
BANDS, ROWS = 20, 5
#: Members of a bucket's lesser groups, and of all its groups, that are compared at once.
BLOCK_FEW, BLOCK_ALL = 64, 512
_MIX = np.random.default_rng(SEED).integers(1, 1 << 63, (2, BANDS * ROWS), np.uint64) | np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of ``width``-word shingles, sorted; of shorter texts, the one of all words."""
    words = WORD.findall((text or "").encode("utf-8", "replace").lower())
    n = max(1, len(words) - width + 1) if words else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(n)), np.uint64, n))


def bands(hashes: np.ndarray) -> list[int]:
    """One key for each band."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), BLOCK >> 4):
        x = hashes[at : at + (BLOCK >> 4), None] * _MIX[0] + _MIX[1]
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
    return [int(np.uint64(xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k)).view(np.int64)) for k in range(BANDS)]


def _pairs(texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(node, other)`` of (id, copy): ``similarity`` or more of their shingles in common."""
    kind = texts.schema["id"].dataType.simpleString()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            made = [bands(h) if len(h := shingles(t.as_py())) else [] for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.list_(pa.int64()))], ["id", "copy", "keys"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            good = []
            for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = shingles(s), shingles(t)
                met = len(np.intersect1d(x, y, assume_unique=True))
                good.append(met >= similarity * (len(x) + len(y) - met))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["node", "other"]).filter(pa.array(good, pa.bool_()))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            made = [shingles(t.as_py()).view(np.int64) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.list_(pa.int64()))], ["id", "copy", "hashes"])

    def compared(less: pa.Table, full: pa.Table) -> pa.Table:
        """Pairs of different groups that are alike, of two blocks of a bucket."""
        sides = [(t["node"].combine_chunks(), t["component"].to_pylist(), [np.asarray(h.values).view(np.uint64) for h in t["hashes"]]) for t in (less, full)]
        (nodes, groups, own), (others, other_groups, held) = sides
        left, right = [], []
        if own and held:
            sizes, flat = np.array([len(h) for h in held]), np.concatenate(held)
            numbers = {tuple(g.values()): k for k, g in enumerate([*groups, *other_groups])}
            codes = np.array([numbers[tuple(g.values())] for g in other_groups])
            for k, x in enumerate(own):
                # Of texts of unequal length the lesser has too few; the rest are counted.
                near_by = (codes != numbers[tuple(groups[k].values())]) & (np.minimum(sizes, len(x)) >= similarity * np.maximum(sizes, len(x)))
                if near_by.any():
                    rows = flat[np.repeat(near_by, sizes)]
                    at = np.minimum(np.searchsorted(x, rows), len(x) - 1)
                    some = sizes[near_by]
                    both = np.add.reduceat(x[at] == rows, np.cumsum(some) - some, dtype=np.int64)
                    good = np.flatnonzero(near_by)[both >= similarity * (len(x) + some - both)]
                    left += [k] * len(good)
                    right += good.tolist()
        return pa.table([nodes.take(pa.array(left, pa.int64())), others.take(pa.array(right, pa.int64()))], ["node", "other"])

    def verified(pairs: DataFrame) -> DataFrame:
        needed = settle(pairs.select("node").union(pairs.select("other")).distinct().select("node.*"), "needed")
        few = needed.count() <= BROADCAST_IDS
        held = settle(texts.join(F.broadcast(needed) if few else needed, ["id", "copy"], "left_semi").select(node, "text"), "texts")
        both = pairs.join(held.toDF("node", "a"), "node").join(held.toDF("other", "b"), "other").select("node", "other", "a", "b")
        return settle(both.mapInArrow(alike, f"node struct<id: {kind}, copy: int>, other struct<id: {kind}, copy: int>"), "near")

    node = F.struct("id", "copy").alias("node")
    keyed = texts.select("id", "copy", "text").mapInArrow(keys, f"id {kind}, copy int, keys array<long>")
    keyed = settle(keyed.select(node, F.explode(F.array_distinct("keys")).alias("key")), "bands")
    least = settle(keyed.groupBy("key").agg(F.min("node").alias("other"), F.max("node").alias("last")).where("other != last"), "buckets")
    members = settle(keyed.join(least, "key"), "members")
    pairs = members.where("node != other").select("node", "other").unionByName(members.where("node != last").select(F.col("last").alias("node"), F.col("node").alias("other")))
    pairs = settle(pairs.distinct(), "candidates")
    near = verified(pairs)
    # Groups that a bucket's least and greatest leave apart may still be joined by a pair of other members.
    groups = connected_components(near, "node", "other")
    members = settle(members.select("key", "node").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "grouped")
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", "n").alias("main"))
    sizes = settle(sizes.where("groups > 1"), "apart")
    rest = members.join(sizes, "key")
    needed = settle(rest.select("node").distinct().select("node.*"), "apart-nodes")
    if needed.isEmpty():
        return near
    few = needed.count() <= BROADCAST_IDS
    hashed = texts.join(F.broadcast(needed) if few else needed, ["id", "copy"], "left_semi").select("id", "copy", "text")
    hashed = settle(hashed.mapInArrow(shingled, f"id {kind}, copy int, hashes array<long>").select(node, "hashes"), "shingles")
    # All but a bucket's largest group meet the members of all other groups, a block of theirs and a block of these at a time.
    count = lambda n, size: F.ceil(n / F.lit(size)).cast("int")
    part = lambda parts: F.pmod(F.xxhash64("node"), parts).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    few_in, all_in = count(F.col("n") - F.col("most"), BLOCK_FEW), count(F.col("n"), BLOCK_ALL)
    rest = rest.join(hashed, "node")
    less = settle(rest.where("component != main").select("key", part(few_in).alias("few"), every(all_in).alias("all"), "node", "component", "hashes"), "apart-members")
    full = rest.select("key", every(few_in).alias("few"), part(all_in).alias("all"), "node", "component", "hashes")
    by = ["key", "few", "all"]
    met = less.groupBy(*by).cogroup(full.groupBy(*by)).applyInArrow(compared, f"node struct<id: {kind}, copy: int>, other struct<id: {kind}, copy: int>")
    return near.unionByName(settle(met.distinct(), "further"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    return texts_of(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null"))


def near_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Pairs ``(id, other)`` with ``similarity`` or more of their 5-word shingles in common; enough of them to connect a bucket's near copies.

    Different texts of one id are documents of their own. Null and wordless texts and null ids have no pair.
    """
    return _pairs(_texts(docs, id_col, text_col)[0], similarity).select(F.col("node.id").alias("id"), F.col("other.id").alias("other"))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the least document of each group of near copies, by id, then by SHA-256 of the text.

    Rows with null ids, and with null or wordless texts, stay; so do rows that repeat an id and its text,
    if the document does. Columns and their order stay. An empty table gives an empty result.
    """
    texts, numbers = _texts(docs, id_col, text_col)
    found = connected_components(_pairs(texts, similarity), "node", "other")
    gone = settle(found.where("node != component").select("node.*"), "near-copies")
    if numbers is None:
        return only(docs, gone.select("id"), id_col, "left_anti")
    several = settle(numbers.select("id").distinct(), "several")
    marks = settle(gone.join(numbers, ["id", "copy"]).select("id", "mark"), "gone")
    left = only(docs, settle(only(gone.select("id"), several, "id", "left_anti").unionByName(several), "dropped"), id_col, "left_anti")
    apart = only(docs, several, id_col)
    return left.unionByName(apart.join(marks, (apart[id_col] == marks["id"]) & (F.unhex(F.sha2(apart[text_col], 256)) == marks["mark"]), "left_anti"))
