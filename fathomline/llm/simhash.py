"""SimHash near-duplicates by covering locality-sensitive hashing.

The 64 bit positions get labels, the vectors 1 .. 2^(r+1) - 1 of r + 1 bits, one after another. Table v keeps
the bits whose label has an odd inner product with v. Any r labels have a common v that is
orthogonal to all of them, so two fingerprints that differ in at most r bits agree in table v: no
pair within the radius is missed. Members of a bucket are compared with each other; a bucket with too
many is cut by covering masks over the bits that its own mask leaves open, as often as needed, so
that no pair within the radius is parted there either.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import connected_components
from .scratch import group_ends, only, settle, small, whole_groups

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
#: Shingles whose bits are counted at once; bounds memory on very long texts.
BLOCK = 1 << 16
#: Members of a bucket that are compared at once; buckets with more are cut by further masks.
BUCKET = 2048
#: Open bits of a mask that no longer is cut: 2^OPEN fingerprints at most are in its buckets.
OPEN = 11


@lru_cache(maxsize=1 << 14)
def covering_masks(radius: int, free: int = (1 << 64) - 1) -> list[int]:
    """One mask of kept bits, out of the ``free`` ones, for each of the 2^(radius+1) - 1 tables.

    Labels that span all others come first, so that each mask keeps a bit of more than ``radius`` free ones.
    """
    size = (1 << radius + 1) - 1
    order = sorted(range(1, size + 1), key=lambda x: (x.bit_count() > 1, x))
    labels = {b: order[i % size] for i, b in enumerate(b for b in range(64) if free >> b & 1)}
    return [sum(1 << b for b, label in labels.items() if (label & v).bit_count() % 2) for v in range(1, size + 1)]


def fingerprint(text: str | None, width: int) -> int:
    """The SimHash of one text over ``width``-word shingles; 0 where it has no word."""
    words = WORD.findall((text or "").encode("utf-8", "replace").lower())  # of bytes, lower() changes A-Z alone
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, ones = len(words) - width + 1, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        spans = zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist(), strict=True)
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in spans), "<u8", to - at)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Rows ``(id, bits)`` with the fingerprint as a signed long. A null text counts as empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            bits = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits)], ["id", "bits"])

    return rows.mapInArrow(each, f"id {kind}, bits long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tree(bits: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Of distinct fingerprints: pairs (numbers) within the radius that connect all such pairs."""
    n = len(bits)
    near = np.empty((n, n), bool)
    for at in range(0, n, 256):
        near[at : at + 256] = np.bitwise_count(bits[at : at + 256, None] ^ bits[None, :]) <= radius
    seen, left, right = np.zeros(n, bool), [], []
    for i in np.flatnonzero(near.sum(axis=1) > 1).tolist():
        if seen[i]:
            continue
        seen[i], stack = True, [i]
        while stack:
            j = stack.pop()
            new = np.flatnonzero(near[j] & ~seen).tolist()
            seen[new] = True
            stack += new
            left += [j] * len(new)
            right += new
    return left, right


def _compared(members: DataFrame, radius: int) -> DataFrame:
    """Edges ``(bits, other)`` within each bucket ``(closed, key)``; its members arrive sorted, as a stream."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("closed", "key")):
            ends, bits = group_ends(table, ("closed", "key")), table["bits"].to_numpy().view(np.uint64)
            sizes, left, right = np.diff(ends), [], []
            two = ends[:-1][sizes == 2]
            two = two[np.bitwise_count(bits[two] ^ bits[two + 1]) <= radius]
            for k in np.flatnonzero(sizes > 2):
                a, b = tree(bits[ends[k] : ends[k + 1]], radius)
                left += [int(ends[k]) + i for i in a]
                right += [int(ends[k]) + i for i in b]
            a, b = (np.concatenate((two + d, np.array(x, np.int64))) for d, x in ((0, left), (1, right)))
            yield pa.RecordBatch.from_arrays([pa.array(bits[a].view(np.int64)), pa.array(bits[b].view(np.int64))], ["bits", "other"])

    return members.repartition("closed", "key").sortWithinPartitions("closed", "key", "bits").mapInArrow(each, "bits long, other long")


def _cut(rows: DataFrame, radius: int) -> DataFrame:
    """``bits``, ``closed``, ``key`` for each row and each further mask over the bits that its own mask ``closed`` leaves open."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 4096):
            bits, closed = (b.column(c).to_numpy().view(np.uint64) for c in ("bits", "closed"))
            for k in np.unique(closed).tolist():
                own = bits[closed == np.uint64(k)]
                for m in covering_masks(radius, ~k & (1 << 64) - 1):
                    wide = np.full(len(own), k | m, np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (own, wide, own & wide)], ["bits", "closed", "key"])

    return rows.mapInArrow(each, "bits long, closed long, key long")


def near_links(nodes: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(bits, other)`` that connect the distinct fingerprints within ``radius`` bits, all of them true links.

    A fingerprint alone in its bucket goes no further. The members of a bucket of up to ``bucket`` are
    compared with each other. Those of a larger one carry its mask and are spread over the buckets of
    further masks over the bits that it leaves open. Each cut closes a bit at least (half of the open
    ones on average), and ``OPEN`` open bits tell at most ``BUCKET`` fingerprints apart, so the cuts
    end; no plan grows with them. Edges grow with the members, not with their pairs.
    """
    first = F.array(*[F.lit(_signed(m)).cast("long") for m in covering_masks(radius)])
    keyed = nodes.select("bits", F.explode(first).alias("closed")).withColumn("key", F.col("bits").bitwiseAND(F.col("closed")))
    parts = []
    while True:
        sizes = settle(keyed.groupBy("closed", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")  # so that the join can split a hot bucket
        many = (F.col("n") > bucket) & (64 - F.bit_count("closed") > max(OPEN, radius))
        members = keyed.join(sizes, ["closed", "key"])
        parts.append(_compared(members.where(~many).select("closed", "key", "bits"), radius))
        if sizes.where(many).isEmpty():
            break
        rows = settle(members.where(many).select("bits", "closed").distinct(), "members")
        keyed = _cut(rows, radius).distinct()  # two masks may have one union
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return settle(found.distinct(), "links")


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int) -> DataFrame:
    """``id``, ``bits``, ``root`` (the least fingerprint reachable) and ``component_id`` of each row."""
    marks = settle(fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "fingerprints")
    nodes = settle(marks.groupBy("bits").agg(F.min("id").alias("first")), "nodes")
    found = connected_components(near_links(nodes.select("bits"), radius), "bits", "other")
    nodes = nodes.join(found.withColumnRenamed("node", "bits"), "bits", "left").select("bits", "first", F.coalesce("component", "bits").alias("root"))
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    by_bits = settle(nodes.join(least, "root").select("bits", "root", "component_id"), "components")
    return marks.join(by_bits, "bits").select("id", "bits", "root", "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row ``(id, fingerprint, component_id)`` for each input row.

    Fingerprints that differ in at most ``radius`` bits are linked; ``component_id`` is the least id
    reachable. Null and wordless texts have fingerprint 0 and link like any other. Rows that repeat
    an id or have a null one keep their rows; nulls are no candidates for a component's id (it is
    null where all of its ids are). Other columns are ignored, whatever their names. An empty table
    gives an empty result.
    """
    found = _components(docs, id_col, text_col, width, radius)
    return found.select("id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one row of each component: one with its least id.

    It is decided by row: of an id with several rows, those go that belong to a component with a lesser
    id; of several rows with the least id of one component, the one with the least fingerprint, then
    text, then hash of all columns stays. Rows with a null id can't be named and stay. Null and empty
    texts are one component. Columns and their order stay. An empty table gives an empty result.
    """
    found = settle(_components(docs, id_col, text_col, width, radius).where("id is not null"), "groups")
    several = settle(found.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"), "several")
    lesser = only(found.where("id != component_id").select("id"), several, "id", "left_anti")
    left = only(docs, settle(lesser.unionByName(several), "dropped"), id_col, "left_anti")
    if several.isEmpty():
        return left
    named = [f"c{k}" for k in range(len(docs.columns))]
    key, text = (named[docs.columns.index(c)] for c in (id_col, text_col))
    rows = settle(only(docs, several, id_col).toDF(*named).withColumn("_mark", F.sha2(F.coalesce(text, F.lit("")), 256)), "repeated")
    marks = fingerprints(rows.select(key, "_mark", text).dropDuplicates([key, "_mark"]).select(F.struct(key, "_mark").alias("at"), text), id_col="at", text_col=text, width=width)
    known = only(found, several, "id").select("id", "bits", "root", "component_id").distinct()
    marks = marks.select(F.col(f"id.{key}").alias("id"), F.col("id._mark").alias("mark"), "bits").join(known, ["id", "bits"]).where("id = component_id")
    rows = rows.join(marks, (F.col(key) == F.col("id")) & (F.col("_mark") == F.col("mark")))
    order = Window.partitionBy("root", "id").orderBy("bits", F.asc_nulls_first(text), F.xxhash64(*named))
    kept = rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select(*named).toDF(*docs.columns)
    return left.unionByName(kept)
