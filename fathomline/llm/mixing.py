"""Mixing sources to target weights by Pfair scheduling of blocks.

A source of weight w, as a share of all, gets for its block j = 1, 2, ... the release time
floor((j - 1) / w) and the deadline ceil(j / w), in slots of one block. Each slot goes to the released
block with the earliest deadline, so that after every slot each source is within one block of its
share. When a source has no block left, the others share its slots: if V runs at the speed at which
each source with blocks left is served at its weight, block j is due at V = j / w, and V comes back to
slots by t(V), the sum over all sources of min(blocks, w V).

Schedules are made in ranges of slots, each by itself. At the end T of a range, all blocks that are due
by then lie before it, and of those that are released, but not yet due, as many as slots are left, the
earliest deadlines first: all later deadlines can then still be met.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import settle, whole_groups

#: The source of all rows whose source has no given weight.
OTHER = "__other__"
#: Slots in a range, unless there are more sources than a quarter of that.
RANGE = 1 << 16


def earliest_first(release: np.ndarray, deadline: np.ndarray) -> np.ndarray:
    """The place of each block: of the released ones, the earliest deadline goes first, the first row on ties.

    Rows are sorted by release; the first place is that of the first release. Where nothing is
    released, the next row goes early.
    """
    n, out, ready, at = len(release), np.zeros(len(release), np.int64), [], 0
    start = int(release[0]) if n else 0
    for place in range(n):
        while at < n and (release[at] <= start + place or not ready):
            heapq.heappush(ready, (int(deadline[at]), at))
            at += 1
        out[heapq.heappop(ready)[1]] = place
    return out


def _ranked(docs: DataFrame, id_col: str, source: Column, size: Column, block: int, bucket_rows: int) -> DataFrame:
    """Rows with ``_block``, from 0 in each source: running size over ``block``, in the order of a hash.

    Sources are cut into hash buckets, which are summed first; the running sum over a source's
    buckets is short, and the one within a bucket holds about ``bucket_rows`` rows whatever the source.
    """
    buckets = max(1, -(-docs.count() // bucket_rows))
    rows = docs.withColumns({"_source": source, "_size": size, "_hash": F.xxhash64(F.col(id_col))})
    rows = rows.withColumn("_bucket", F.pmod(F.shiftright("_hash", 8), F.lit(buckets)))
    sums = rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_source", "_bucket").orderBy("_hash", F.col(id_col), "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    return rows.join(sums, ["_source", "_bucket"]).withColumn("_block", F.floor((F.col("_start") + F.col("_before")) / F.lit(block)))


def _running(rows: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """``rows`` with ``_<column>``, the sum over all rows before and the row itself, for each column of ``sums``.

    Rows are sorted into ranges; only the ranges' sums come to the driver, one row for each partition.
    """
    cut = settle(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = sorted(cut.groupBy("_part").agg(*[F.sum(c).alias(c) for c in sums]).collect())
    base, at = [], [0.0] * len(sums)
    for r in totals:
        base.append((r["_part"], *at))
        at = [a + r[c] for a, c in zip(at, sums, strict=True)]
    starts = rows.sparkSession.createDataFrame(base, ", ".join(["_part int", *(f"_start_{c} double" for c in sums)]))
    so_far = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cut.join(F.broadcast(starts), "_part")  # a row for each partition
    return out.withColumns({f"_{c}": F.col(f"_start_{c}") + F.sum(c).over(so_far) for c in sums}).drop("_part", *(f"_start_{c}" for c in sums))


def windows(sources: DataFrame) -> DataFrame:
    """``source``, ``block``, ``release``, ``deadline`` of each block of ``sources`` (source, weight, blocks)."""
    total = sources.agg(F.sum("weight").alias("w")).first()["w"] or 1.0
    sources = settle(sources.withColumn("weight", F.col("weight") / F.lit(float(total))), "weights")
    salt = F.xxhash64("source").alias("salt")
    ends = sources.select((F.col("blocks") / F.col("weight")).alias("v"), salt, "source", F.lit(-1).cast("long").alias("block"), F.lit(0).alias("end"), F.col("blocks").cast("double").alias("n"), F.col("weight").alias("w"))
    asked = sources.select("weight", salt, "source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    asked = asked.select("weight", "salt", "source", "block", F.explode(F.array(F.lit(0), F.lit(1))).alias("end"))
    asked = asked.select(((F.col("block") + F.col("end")) / F.col("weight")).alias("v"), "salt", "source", "block", "end", F.lit(0.0).alias("n"), F.lit(0.0).alias("w"))
    # t(V) = blocks of the sources that have ended, and V times the weights of the others
    at = _running(ends.unionByName(asked), ["v", "salt", "block", "end"], ["n", "w"]).where("block >= 0")
    time = F.col("_n") + F.col("v") * F.greatest(F.lit(1.0) - F.col("_w"), F.lit(0.0))
    near = F.round(time)  # sums of doubles miss whole numbers by a little
    time = F.when(F.abs(time - near) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(near)), near).otherwise(time)
    at = at.select("source", "block", "end", F.when(F.col("end") == 0, F.floor(time)).otherwise(F.ceil(time)).cast("long").alias("t"))
    found = at.groupBy("source", "block").agg(F.max(F.when(F.col("end") == 0, F.col("t"))).alias("release"), F.max(F.when(F.col("end") == 1, F.col("t"))).alias("deadline"))
    return found.withColumn("deadline", F.greatest("deadline", F.col("release") + 1))


def schedule(blocks: DataFrame, size: int) -> DataFrame:
    """``slot`` of each of the ``blocks`` (source, block, release, deadline), in ranges of ``size`` slots."""
    keys = ["source", "block", "release", "deadline"]
    blocks = settle(blocks.select(*keys, F.floor(F.col("release") / size).alias("lo"), F.floor((F.col("deadline") - 1) / size).alias("hi")), "windows")
    # Blocks with a deadline in each range; of those that reach over a range's end, so many as it has slots left stay in it.
    due = blocks.groupBy(F.col("hi").alias("range")).agg(F.count("*").alias("due"))
    over = blocks.where("lo < hi").select(*keys, "lo", "hi", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("range"))
    nth = F.row_number().over(Window.partitionBy("range").orderBy("deadline", "release", "source"))
    over = over.withColumn("nth", nth)
    counts = sorted((r["range"], r["due"]) for r in due.collect())  # one for each range
    left, sum_ = [], 0
    known = dict(counts)
    for k in range(counts[-1][0] + 1 if counts else 0):
        sum_ += known.get(k, 0)
        left.append((k, (k + 1) * size - sum_))
    spare = blocks.sparkSession.createDataFrame(left, "range long, spare long")
    early = over.join(F.broadcast(spare), "range").where("nth <= spare").groupBy("source", "block").agg(F.min("range").alias("early"))
    placed = blocks.join(early, ["source", "block"], "left").select(*keys, F.coalesce("early", "hi").alias("range"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("range",)):
            ranges = table["range"].to_numpy()
            for k in np.unique(ranges):
                one = table.filter(pa.array(ranges == k))
                start = int(k) * size
                release = np.maximum(one["release"].to_numpy(), start)
                slots = pa.array(start + earliest_first(release, one["deadline"].to_numpy()))
                yield from one.select(keys).append_column("slot", slots).combine_chunks().to_batches()

    kind = blocks.schema["source"].dataType.simpleString()
    rows = placed.repartition("range").sortWithinPartitions("range", F.greatest("release", F.col("range") * size), "deadline", "source", "block")
    return rows.mapInArrow(each, f"source {kind}, block long, release long, deadline long, slot long")


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    block_chars: int = 100_000,
    power: float = 0.5,
    bucket_rows: int = 500,
    range_slots: int = RANGE,
) -> DataFrame:
    """One row for each input row: ``id``, ``source``, ``block``, ``slot``, ``release``, ``deadline``, ``place``.

    A block is a run of a source's documents of about ``block_chars`` characters (one longer text is a
    block of its own); the order within a source is that of a hash of the id. Reading by (slot, place)
    gives the mixture; no row is dropped or repeated, and once a source has no block left the others
    share on. ``release`` and ``deadline`` are in slots from the start of the schedule; every block
    has its slot between them. Without ``weights``, a source weighs its characters (one at least) to
    the ``power``; with them, the sources that they don't name make up one, which weighs
    ``weights[OTHER]`` or, without that, as much as the least. There may be any number of sources. A null source is
    the source ''. Rows that repeat an id keep their rows, one after another; null texts have length
    0. Other columns are ignored. An empty table gives an empty result.
    """
    rows = settle(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("chars")), "sizes")
    if weights is not None and (not weights or min(weights.values()) <= 0):
        raise ValueError("each weight must be positive")
    named = None if weights is None else [s for s in weights if s != OTHER]
    group = F.col("source") if named is None else F.when(F.col("source").isin(named), F.col("source")).otherwise(F.lit(OTHER))
    ranked = settle(_ranked(rows, "id", group, F.col("chars"), block_chars, bucket_rows), "blocks")
    # Numbers of blocks without gaps: a text longer than a block leaves out the ones that it fills.
    filled = ranked.groupBy("_source", "_block").agg(F.sum("chars").alias("chars"))
    numbered = settle(_numbered(filled), "filled")
    sources = numbered.groupBy("_source").agg(F.count("*").alias("blocks"), F.sum("chars").alias("chars"))
    if weights is None:
        weight = F.pow(F.greatest("chars", F.lit(1)).cast("double"), F.lit(power))
    else:
        told = {**weights, OTHER: weights.get(OTHER, min(weights.values()))}
        weight = F.element_at(F.create_map(*[F.lit(x) for s, w in told.items() for x in (s, float(w))]), F.col("_source"))
    sources = settle(sources.select(F.col("_source").alias("source"), weight.alias("weight"), "blocks"), "sources")
    slots = schedule(windows(sources), max(range_slots, 4 * sources.count()))
    by_block = numbered.join(slots.withColumnsRenamed({"source": "_source", "block": "nth"}), ["_source", "nth"])
    by_block = settle(by_block.select("_source", "_block", "nth", "slot", "release", "deadline"), "slots")
    out = ranked.join(by_block, ["_source", "_block"])
    return out.select("id", "source", F.col("nth").alias("block"), "slot", "release", "deadline", (F.col("_start") + F.col("_before")).alias("place"))


def _numbered(filled: DataFrame, width: int = 10_000) -> DataFrame:
    """``_source``, ``_block``, ``chars`` with ``nth``: the blocks of a source that hold rows, from 0. Counted in ranges of ``width`` block numbers."""
    filled = filled.withColumn("_range", F.floor(F.col("_block") / width))
    counts = filled.groupBy("_source", "_range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_source", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("_source", "_range").orderBy("_block"))
    return filled.withColumn("_in", within).join(counts, ["_source", "_range"]).select("_source", "_block", "chars", (F.col("first") + F.col("_in") - 1).alias("nth"))


def mix_documents(docs: DataFrame, weights: dict[str, float] | None = None, *, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` in the order of the mixture, all rows and columns, for a writer that keeps the order.

    Rows that repeat an id go where its first one goes. Rows with a null id come last. An empty table
    gives an empty result.
    """
    where = mix(docs, weights, id_col=id_col, **how).where("id is not null").groupBy("id").agg(F.min(F.struct("slot", "place")).alias("_at"))
    named = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(n) for c, n in named.items()])
    rows = rows.join(where, rows[named[id_col]] == where["id"], "left")
    order = [F.coalesce("_at.slot", F.lit((1 << 63) - 1)), F.col("_at.place"), F.col(named[id_col])]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.select(*[F.col(n).alias(c) for c, n in named.items()])
