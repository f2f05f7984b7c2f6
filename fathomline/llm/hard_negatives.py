"""Hard negatives by an angular triangle filter.

Each row stores its angles to a few reference directions. By the triangle inequality of angles, the
angle of an anchor at alpha and a row at beta from one reference lies between |alpha - beta| and
alpha + beta; its cosines times both norms bound their inner product. A block holds rows of one
reference's neighbourhood in the order of their angle, so the rows whose bounds overlap an anchor's
window of scores are one range of it, and only those are scored, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import top_k
from .grid import Best, against
from .scratch import BROADCAST_IDS, settle, small

SEED = 20_240_711
#: Rows in a block; anchors in a block.
BLOCK, ANCHORS = 2048, 1024
#: Angles are widened by this much, and norms in proportion: far more than doubles lose in arccos, sums and roots.
PAD, SLACK = 1e-6, 1e-9


def _scaled(vectors: DataFrame, scale: float) -> DataFrame:
    """``id``, ``label``, ``anchor``, ``dims``, ``x`` (32-bit integers as bytes), ``norm`` of the rows that take part."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 2048):
            data, norms, dims = [], [], []
            for v in b.column(3):
                x = None if not v.is_valid or v.values.null_count else np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                with np.errstate(over="ignore"):
                    x = np.floor(scale * x) if x is not None and len(x) and np.isfinite(x).all() else None
                    norm = float(np.sqrt((x * x).sum())) if x is not None else np.inf
                good = norm < 1 << 31
                data.append(x.astype("<i4").tobytes() if good else None)
                norms.append(norm if good else None)
                dims.append(len(x) if good else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(dims, pa.int32()), pa.array(data, pa.binary()), pa.array(norms, pa.float64())], ["id", "label", "anchor", "dims", "x", "norm"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.mapInArrow(each, f"id long, label {kinds['label']}, anchor boolean, dims int, x binary, norm double").where("x is not null")


def _references(rows: DataFrame, count: int, total: int) -> dict[int, np.ndarray]:
    """Unit vectors for each length of vectors: some distinct rows by a hash of their numbers, filled up with random directions."""
    share = max(1, total // (8 * count))
    drawn = rows.where(F.pmod(F.xxhash64("x"), F.lit(share)) == 0).where("norm > 0").select("dims", "x").distinct()
    found: dict[int, list] = {r["dims"]: [] for r in rows.select("dims").distinct().collect()}
    for r in drawn.orderBy(F.xxhash64("x"), "x").limit(8 * count).collect():
        found[r["dims"]].append(np.frombuffer(r["x"], "<i4").astype(np.float64))
    out = {}
    for dims, got in found.items():
        filled = np.random.default_rng([SEED, dims]).standard_normal((count, dims))
        for k, v in enumerate(got[:count]):
            filled[k] = v
        out[dims] = filled / np.sqrt((filled * filled).sum(axis=1, keepdims=True))
    return out


def angles(x: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of rows to references; a right angle for a zero row, whose scores are 0 by any bound."""
    dots = x @ references.T
    return np.arccos(np.clip(np.divide(dots, norms[:, None], out=np.zeros_like(dots), where=norms[:, None] > 0), -1, 1))


def _placed(rows: DataFrame, references: dict[int, np.ndarray]) -> DataFrame:
    """Each row with its angles to all references, the nearest one (``cell``) and the angle to it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 2048):
            dims, cell, angle, every = b.column(3).to_numpy(), np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows), np.empty(b.num_rows, object)
            norms = b.column(5).to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = np.frombuffer(b"".join(b.column(4).take(pa.array(at)).to_pylist()), "<i4").reshape(len(at), d)
                a = angles(x.astype(np.float64), norms[at], references[d])
                cell[at] = a.argmin(axis=1)
                angle[at] = a.min(axis=1)
                for i, row in zip(at, a, strict=True):
                    every[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle), pa.array(every, pa.binary())], [*b.schema.names, "cell", "angle", "angles"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(each, f"{kinds}, cell int, angle double, angles binary")


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """Neighbouring rows of one length and cell, up to ``most``, as one row of arrays."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, most, 1 << 62):
            key = b.column(3).to_numpy().astype(np.int64) << 32 | b.column(6).to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(ends, ends[1:], strict=False):
                p = b.slice(lo, hi - lo)
                data = {"dims": [p.column(3)[0].as_py()], "cell": [p.column(6)[0].as_py()], "ids": [p.column(0).to_numpy().tobytes()]}
                data |= {c: [b"".join(p.column(c).to_pylist())] for c in ("x", "angles")} | {"norms": [p.column(5).to_numpy().tobytes()]}
                labels = pa.ListArray.from_arrays(pa.array([0, len(p)], pa.int32()), p.column(1))
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(data.values(), (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)] + [labels], [*data, "labels"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(each, f"dims int, cell int, ids binary, x binary, angles binary, norms binary, labels array<{label}>")


@dataclass
class Side:
    """A block as arrays: of all rows (sorted by the angle to the own reference) or of anchors."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    angles: np.ndarray
    norms: np.ndarray
    cell: int = 0

    @classmethod
    def of(cls, row: pa.RecordBatch, prefix: str = "") -> Side:
        get = lambda c: row[f"{prefix}{c}"][0]
        ids, x, every, norms = (np.frombuffer(get(c).as_buffer(), kind) for c, kind in (("ids", "<i8"), ("x", "<i4"), ("angles", "<f8"), ("norms", "<f8")))
        labels = np.asarray(get("labels").values.to_numpy(zero_copy_only=False))
        return cls(ids, labels, x.reshape(len(ids), -1), every.reshape(len(ids), -1), norms, get("cell").as_py())


def overlapping(anchors: Side, rows: Side, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor, whether a row's bounds may reach [least, most], and the range of rows where they do.

    The block as a whole is held against all references; its rows, by a binary search, against the
    block's own.
    """
    top, low = rows.norms.max() * (1 + SLACK), rows.norms.min() * (1 - SLACK)
    size = anchors.norms * (1 + SLACK)
    with np.errstate(divide="ignore", invalid="ignore"):
        # score <= size * top * cos(gap): it reaches a positive ``least`` only within this gap
        gap = np.where(least > 0, np.arccos(np.clip(np.nan_to_num(least / (size * top), nan=0.0, posinf=2.0), -1, 1)) + PAD, np.inf)
        may = (least <= most) & ~((least > 0) & (size * top < least))
        # score >= size * low * cos(alpha + beta): it stays within ``most`` only beyond this sum
        small_size = anchors.norms * (1 - SLACK)
        wide = np.where((most >= 0) & (small_size * low > most), np.arccos(np.clip(most / (small_size * low), -1, 1)) - PAD, -np.inf)
    lo, hi = rows.angles.min(axis=0), rows.angles.max(axis=0)
    apart = np.maximum(lo[None] - anchors.angles, anchors.angles - hi[None]).max(axis=1)
    may &= (apart <= gap) & ((anchors.angles + hi[None]).min(axis=1) >= wide)
    own, sorted_angles = anchors.angles[:, rows.cell], rows.angles[:, rows.cell]
    first = np.searchsorted(sorted_angles, np.maximum(own - gap, wide - own) - PAD)
    last = np.searchsorted(sorted_angles, own + gap + PAD, "right")
    return may & (first < last), first, last


def products(a: Side, pick: np.ndarray, b: Side, lo: int, hi: int) -> np.ndarray:
    """Integer inner products: by doubles where each sum stays below 2^53, and so is exact, else by longs."""
    if a.norms[pick].max() * b.norms[lo:hi].max() < 1 << 52:
        return a.x[pick].astype(np.float64) @ b.x[lo:hi].astype(np.float64).T
    return a.x[pick].astype(np.int64) @ b.x[lo:hi].astype(np.int64).T


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Side, Side, pa.RecordBatch]]:
    """Number and rows of the anchors' block, the other block and the row that holds both, for vectors of one length.

    Anchors stay unpacked, as they come again with each block; one broadcast or cell of the grid
    bounds them.
    """
    held: dict[int, Side] = {}
    for b in batches:
        for at in range(b.num_rows):
            row, no = b.slice(at, 1), b.column("q_no")[at].as_py()
            if row["dims"][0] != row["q_dims"][0]:
                continue
            if no not in held:
                held[no] = Side.of(row, "q_")
            yield no, held[no], Side.of(row), row


def _positives(pairs: DataFrame, count: int) -> DataFrame:
    """``q_no``, ``at``, ``positive_id``, ``positive_score``: the first rows of the anchor's label in what a task has seen."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Best] = {}
        for no, anchors, rows, _ in _sides(batches):
            best = seen.setdefault(no, Best(len(anchors.ids), count, np.int64))
            may, first, last = overlapping(anchors, rows, best.least, np.full(len(anchors.ids), np.inf))
            if not may.any():
                continue
            pick, lo, hi = np.flatnonzero(may), first[may].min(), last[may].max()
            same = (anchors.labels[pick][:, None] == rows.labels[None, lo:hi]) & (anchors.ids[pick][:, None] != rows.ids[None, lo:hi])
            best.add(pick, products(anchors, pick, rows, lo, hi), rows.ids[lo:hi], same)
        for no, best in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best.rows), no)), pa.array(best.rows), pa.array(best.ids), pa.array(best.scores)], ["q_no", "at", "positive_id", "positive_score"])

    return pairs.mapInArrow(each, "q_no long, at long, positive_id long, positive_score long")


def windows(scores: np.ndarray, least: tuple[int, int], most: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest integers n with ``least`` * p <= n <= ``most`` * p, for integers p; exact."""
    p = scores.astype(object)
    low, high = -(-(least[0] * p) // least[1]), most[0] * p // most[1]
    return low.astype(np.int64), high.astype(np.int64)


def _negatives(pairs: DataFrame, count: int, least: tuple[int, int], most: tuple[int, int]) -> DataFrame:
    """``anchor``, ``positive``, ``positive_score``, ``negative_id``, ``score``: a task's first rows of each window; ``list`` names the window."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple] = {}
        for no, anchors, rows, row in _sides(batches):
            if no not in seen:
                at, ids, scores = (row["positives"][0].values.field(c).to_numpy().astype(np.int64) for c in ("at", "positive_id", "positive_score"))
                low, high = windows(scores, least, most)
                seen[no] = (at, ids, scores, low, high, Best(len(at), count, np.int64), anchors.ids)
            at, _, _, low, high, best, _ = seen[no]
            n = len(anchors.ids)
            need, reach = np.full(n, np.inf), np.full(n, -np.inf)
            floor = np.where(low <= high, np.maximum(low, best.least), np.inf)
            np.minimum.at(need, at, floor)
            np.maximum.at(reach, at, np.where(low <= high, high.astype(np.float64), -np.inf))
            may, first, last = overlapping(anchors, rows, need, reach)
            if not may.any():
                continue
            pick, lo, hi = np.flatnonzero(may), first[may].min(), last[may].max()
            scores, place = products(anchors, pick, rows, lo, hi), np.full(n, -1)
            place[pick] = np.arange(len(pick))
            other = (anchors.labels[pick][:, None] != rows.labels[None, lo:hi]) & (anchors.ids[pick][:, None] != rows.ids[None, lo:hi])
            lists = np.flatnonzero((place[at] >= 0) & (low <= high))
            for some in np.array_split(lists, max(1, len(lists) * (hi - lo) >> 20)):
                s = scores[place[at[some]]]
                best.add(some, s, rows.ids[lo:hi], other[place[at[some]]] & (s >= low[some, None]) & (s <= high[some, None]))
        for no, (at, ids, scores, _, _, best, anchor_ids) in seen.items():
            k = best.rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), no)), pa.array(k), pa.array(anchor_ids[at[k]]), pa.array(ids[k]), pa.array(scores[k]), pa.array(best.ids), pa.array(best.scores)], ["q_no", "list", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return pairs.mapInArrow(each, "q_no long, list long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")


def _bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.sum(F.octet_length("x") + F.octet_length("angles"))).first()[0] or 0


def hard_negatives(
    vectors: DataFrame, anchor: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256, positives: int = 5, negatives: int = 10,
    least: tuple[int, int] = (30, 100), most: tuple[int, int] = (90, 100), references: int = 16, block: int = BLOCK,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Components become floor(``scale`` * x); a score is the inner product of these integers. Anchors are
    the rows where ``anchor`` (a condition on the columns of ``vectors``) holds. Their positives are
    their first ``positives`` rows of the same label, by falling score, then rising id. For each
    positive the first ``negatives`` rows of another label are returned whose score n lies in
    ``least`` * p <= n <= ``most`` * p, of its score p (both as fractions, tested in integers).

    Rows take no part whose id, label or vector is null, whose vector is empty or has null or
    non-finite components, or whose scaled length is 2^31 or more (its scores needn't fit a long).
    Vectors of different length have no score. Rows that repeat an id, label and vector count once;
    rows of one id that differ in these are rows of their own, but none of an id is a positive or
    negative of that id. Other columns are ignored, whatever their names. An empty table, or one
    without anchors, positives or rows within the window, gives no rows.
    """
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).alias("vec"))
    rows = settle(_scaled(given.where("id is not null and label is not null and vec is not null"), scale), "scaled")
    several = settle(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "several")
    if not several.isEmpty():
        known = F.broadcast(several) if several.count() <= BROADCAST_IDS else several
        rows = settle(rows.join(known, "id", "left_anti").unionByName(rows.join(known, "id", "left_semi").dropDuplicates(["id", "label", "x", "dims"])), "distinct")
    placed = _placed(rows, _references(rows, references, rows.count()))
    order = ("dims", "cell", "angle", "id")
    blocks = settle(_blocks(placed.repartitionByRange(*order).sortWithinPartitions(*order), block), "blocks")
    asked = _blocks(placed.where("anchor").sortWithinPartitions("dims").withColumn("cell", F.lit(0)), ANCHORS)
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns], F.monotonically_increasing_id().alias("q_no"))
    asked = settle(asked, "anchors")
    size, asked_size = _bytes(blocks), _bytes(asked.withColumnsRenamed({"q_x": "x", "q_angles": "angles"}))
    best = top_k(_positives(against(blocks, asked, size, asked_size), positives), ["q_no", "at"], [F.desc("positive_score"), F.asc("positive_id")], positives)
    listed = best.groupBy("q_no").agg(F.sort_array(F.collect_list(F.struct("at", "rank", "positive_id", "positive_score"))).alias("positives"))  # at most ANCHORS * positives
    asked = settle(asked.join(listed, "q_no"), "windows")
    found = _negatives(against(blocks, asked, size, asked_size), negatives, least, most)
    ranked = top_k(found, ["q_no", "list"], [F.desc("negative_score"), F.asc("negative_id")], negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
