"""An approximate vector index: cells of k-means, product-quantised residuals, exact scores of a short list.

The index is a folder: ``vectors/cell=C`` (id, code, vec), so that a search reads the probed cells
alone, and ``model``, one row with the centres. Cells and codebooks are fitted to a bounded sample; every
vector is indexed. Vectors are taken at length 1, so that the order of distances is that of cosines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import settle
from .ranking import top_k

#: Rows that cells and codebooks are fitted to, about; parts of a vector and centres of a codebook.
SAMPLE, PARTS, CODES = 20_000, 8, 64
#: Vectors, and queries, of a block.
BLOCK, QUERIES = 4096, 256


@dataclass
class Model:
    """``cells``: a centre a row; ``books``: for each part of a vector, a residual's centre a row."""

    cells: np.ndarray
    books: list[np.ndarray]

    @property
    def spans(self) -> list[np.ndarray]:
        return np.array_split(np.arange(self.cells.shape[1]), len(self.books))

    def nearest_cells(self, x: np.ndarray, count: int) -> np.ndarray:
        d = (self.cells * self.cells).sum(axis=1)[None] - 2 * x @ self.cells.T
        return np.argsort(d, axis=1, kind="stable")[:, :count]

    def encode(self, residual: np.ndarray) -> np.ndarray:
        codes = [((b * b).sum(axis=1)[None] - 2 * residual[:, s] @ b.T).argmin(axis=1) for b, s in zip(self.books, self.spans, strict=True)]
        return np.stack(codes, axis=1).astype(np.uint8)

    def distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries, less the cell's centre, from coded rows: sums of looked-up parts."""
        out = np.zeros((len(residual), len(codes)))
        for k, (b, s) in enumerate(zip(self.books, self.spans, strict=True)):
            table = ((residual[:, None, s] - b[None]) ** 2).sum(axis=2)
            out += table[:, codes[:, k]]
        return out


def _unit(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and unit rows of the vectors that have the length, numbers throughout and aren't zero."""
    at, rows = [], []
    for k, v in enumerate(column.to_pylist()):
        if v and len(v) == dims and None not in v:
            x = np.array(v, np.float64)
            top = np.abs(x).max()
            if np.isfinite(top) and top > 0:
                x = x / top
                at.append(k)
                rows.append(x / np.sqrt(x @ x))
    return np.array(at, np.int64), np.array(rows).reshape(len(rows), dims)


def _units(df: DataFrame, dims: int) -> DataFrame:
    """``id``, ``unit`` of the rows that can be searched."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _unit(b.column(1), dims)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(list(x), pa.list_(pa.float64()))], ["id", "unit"])

    return df.mapInArrow(each, "id long, unit array<double>")


def _codebook(size: int):
    """A grouped function: Lloyd's rounds on one part of the sampled residuals, from evenly spaced rows."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows.sort_values("id")["part"].tolist())
        centres = np.unique(x, axis=0)
        centres = centres[np.linspace(0, len(centres) - 1, min(size, len(centres))).astype(int)]
        for _ in range(12):
            own = ((centres * centres).sum(axis=1)[None] - 2 * x @ centres.T).argmin(axis=1)
            sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
            np.add.at(sums, own, x)
            centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        return pd.DataFrame({"no": [int(rows["no"].iloc[0])], "book": [centres.ravel().tolist()]})

    return fit


def fit(vectors: DataFrame, cells: int, *, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, parts: int = PARTS, codes: int = CODES) -> Model | None:
    """Centres fitted to about ``sample`` rows, chosen by a hash of the id; None where no row can be searched."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    usual = rows.where("size(vec) > 0").groupBy(F.size("vec").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    if usual is None:
        return None
    dims, share = usual["dims"], min(1.0, sample / usual["n"])
    drawn = settle(_units(rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < round(share * (1 << 40))), dims), "sample")
    if drawn.isEmpty():
        drawn = settle(_units(rows, dims), "sample")
        if drawn.isEmpty():
            return None
    model = KMeans(k=cells, seed=11, maxIter=15, featuresCol="v").fit(drawn.select(array_to_vector("unit").alias("v")))
    centres = np.array(model.clusterCenters())
    first = Model(centres, [np.zeros((1, len(s))) for s in np.array_split(np.arange(dims), min(parts, dims))])

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _unit(b.column(1), dims)
            if not len(at):
                continue
            rest = x - centres[first.nearest_cells(x, 1)[:, 0]]
            for no, s in enumerate(first.spans):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), no), pa.int32()), b.column(0).take(pa.array(at)), pa.array(list(rest[:, s]), pa.list_(pa.float64()))], ["no", "id", "part"])

    split = drawn.mapInArrow(residuals, "no int, id long, part array<double>")
    books = {r["no"]: r["book"] for r in split.groupBy("no").applyInPandas(_codebook(codes), "no int, book array<double>").collect()}  # one bounded book a part
    return Model(centres, [np.array(books[no]).reshape(-1, len(s)) for no, s in enumerate(first.spans)])


def build(vectors: DataFrame, path: str, model: Model, *, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
    """Write the index. Every row with a vector of the model's length that isn't zero and has numbers throughout is in it.

    A cell with most rows is split over tasks and files by adaptive execution.
    """
    spark, dims = vectors.sparkSession, model.cells.shape[1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _unit(b.column(1), dims)
            if not len(at):
                continue
            cell = model.nearest_cells(x, 1)[:, 0]
            codes = model.encode(x - model.cells[cell])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(list(x), pa.list_(pa.float64()))], ["id", "cell", "code", "vec"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec")).mapInArrow(each, "id long, cell int, code binary, vec array<double>")
    rows.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    row = (model.cells.tobytes(), dims, [b.tobytes() for b in model.books])
    spark.createDataFrame([row], "cells binary, dims int, books array<binary>").coalesce(1).write.parquet(f"{path}/model")


def load(spark: SparkSession, path: str) -> tuple[Model, DataFrame]:
    """The centres, and the table of vectors."""
    row = spark.read.parquet(f"{path}/model").first()
    cells = np.frombuffer(row["cells"]).reshape(-1, row["dims"])
    spans = np.array_split(np.arange(row["dims"]), len(row["books"]))
    books = [np.frombuffer(b).reshape(-1, len(s)) for b, s in zip(row["books"], spans, strict=True)]
    return Model(cells, books), spark.read.schema("id long, code binary, vec array<double>, cell int").parquet(f"{path}/vectors")


def probed(queries: DataFrame, model: Model, probes: int, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``cell``, ``vec``: the ``probes`` nearest cells of each query."""
    count = min(probes, len(model.cells))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _unit(b.column(1), model.cells.shape[1])
            if len(at):
                cells = model.nearest_cells(x, count)
                again = np.repeat(np.arange(len(at)), count)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[again])), pa.array(cells.ravel(), pa.int32()), pa.array(list(x[again]), pa.list_(pa.float64()))], ["query_id", "cell", "vec"])

    return queries.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(each, "query_id long, cell int, vec array<double>")


def _packed(rows: DataFrame, most: int, names: tuple[str, str, str]) -> DataFrame:
    """Neighbouring rows of a cell, ``most`` or less: their ids and payloads (bytes or doubles) as bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column(0).to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(ends, ends[1:], strict=False):
                for at in range(lo, hi, most):
                    p = b.slice(at, min(most, hi - at))
                    data = b"".join(p.column(2).to_pylist()) if pa.types.is_binary(p.column(2).type) else np.array(p.column(2).to_pylist()).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([int(cell[lo])], pa.int32()), pa.array([p.column(1).to_numpy().tobytes()]), pa.array([data])], list(names))

    return rows.mapInArrow(each, f"{names[0]} int, {names[1]} binary, {names[2]} binary")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, *, probes: int, short: int = 200, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``vec_id``, ``score`` (cosine, six decimals), ``rank``: the ``k`` nearest found, other than the query's own id.

    Each query meets the codes of the rows in its ``probes`` nearest cells, by blocks; of each query's
    ``short`` nearest codes the vectors are read and scored exactly. Ties go to the lesser id.
    """
    model, table = load(spark, path)
    asked = settle(probed(queries, model, probes, id_col=id_col, vector_col=vector_col), "probes")
    cells = [r[0] for r in asked.select("cell").distinct().collect()]  # at most the cells there are
    rows = table.where(F.col("cell").isin(cells) if cells else F.lit(False))
    blocks = _packed(rows.select("cell", "id", "code"), BLOCK, ("cell", "ids", "codes"))
    q_blocks = settle(_packed(asked.select("cell", "query_id", "vec").repartition("cell").sortWithinPartitions("cell"), QUERIES, ("cell", "q_ids", "q")), "query-blocks")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, q_ids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["q_ids"], "<i8")
                codes, q = np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(r["q"]).reshape(len(q_ids), -1)
                d = model.distances(q - model.cells[r["cell"]], codes)
                d[q_ids[:, None] == ids[None]] = np.inf
                count = min(short, len(ids))
                best = np.argpartition(d, count - 1, axis=1)[:, :count]
                at = np.repeat(np.arange(len(q_ids)), count)
                gap = d[at, best.ravel()]
                ok = np.isfinite(gap)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at][ok]), pa.array(ids[best.ravel()][ok]), pa.array(np.full(ok.sum(), r["cell"]), pa.int32()), pa.array(gap[ok])], ["query_id", "id", "cell", "gap"])

    listed = top_k(blocks.join(q_blocks, "cell").select("cell", "ids", "codes", "q_ids", "q").mapInArrow(near, "query_id long, id long, cell int, gap double"), ["query_id"], [F.asc("gap"), F.asc("id")], short)
    listed = settle(listed.select("query_id", "id", "cell"), "short-list")
    own = asked.groupBy("query_id").agg(F.first("vec").alias("q"))
    scored = listed.join(rows.select("cell", "id", "vec"), ["cell", "id"]).join(own, "query_id")
    scored = scored.select("query_id", F.col("id").alias("vec_id"), F.round(V.dot("q", "vec"), 6).alias("score")).distinct()
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)


def rows_met(spark: SparkSession, path: str, queries: DataFrame, probes: int, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row: ``share`` of all indexed vectors whose codes a query meets, on average."""
    model, table = load(spark, path)
    sizes = table.groupBy("cell").agg(F.count("*").alias("n"))
    met = probed(queries, model, probes, id_col=id_col, vector_col=vector_col).join(F.broadcast(sizes), "cell").groupBy("query_id").agg(F.sum("n").alias("n"))  # a row a cell
    return met.agg(F.avg("n").alias("n")).crossJoin(table.agg(F.count("*").alias("all"))).select((F.col("n") / F.col("all")).alias("share"))
