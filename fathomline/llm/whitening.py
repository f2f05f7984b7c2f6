"""Whitening by an incremental eigendecomposition.

Each partition keeps the mean and the spectrum (eigenvalues and eigenvectors) of the scatter of its
rows and changes them by a rank-one update for each row: the roots of a secular equation between the
old eigenvalues, with deflation of components that the update doesn't touch. Spectra of partitions are
combined by rank-one updates, one for each direction of the other and one for the distance of the
means. A Rayleigh-Ritz step over all rows, centred exactly, refines the combined basis.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import settle, small

#: Entries are scaled, rounded down and moved by these.
SCALE, OFFSET = 64, 1_000_000
#: States of partitions that one task combines.
FAN_IN = 32
EPS = np.finfo(np.float64).eps


@lru_cache(maxsize=256)
def _shape(n: int) -> tuple[np.ndarray, ...]:
    """Of ``n`` roots: the lesser of the two poles of each one's model, the greater one, the poles on the lesser side, pairs i < j and i >= j."""
    at = np.arange(n)
    last = at == n - 1
    p, q = np.maximum(at - last, 0), np.minimum(at + 1, n - 1)
    side = (at[None] <= p[:, None]).astype(np.float64)
    return p, q, side, *np.nonzero(at[:, None] < at[None]), *np.nonzero((at[:, None] >= at[None]) & ~last[:, None])


def secular_roots(d: np.ndarray, z: np.ndarray) -> np.ndarray:
    """``out[i, j]`` = d_j - root_i of 1 + sum z_j^2 / (d_j - root) = 0, for rising distinct ``d`` and ``z`` without zeros.

    Each root is sought from its nearer pole, as an offset, so that the differences keep full
    precision: steps of a rational model with the two neighbouring poles, within a bracket that
    each step shrinks, and halving where a step leaves it.
    """
    n, w = len(d), z * z
    if n == 1:
        return np.array([[-w[0]]])
    p, q, side, *_ = _shape(n)
    rows = np.arange(n)
    last = rows == n - 1
    gap = np.append(np.diff(d), w.sum())
    middle = 1 + (w / ((d[None] - d[:, None]) - gap[:, None] / 2)).sum(axis=1)
    poles = d[None] - d[np.where((middle >= 0) | last, rows, q)][:, None]  # [root, pole], from the root's origin
    low = np.where(middle >= 0, 0.0, np.where(last, gap / 2, -gap / 2))
    high = np.where(middle >= 0, gap / 2, np.where(last, gap, 0.0))
    mu, live, own = (low + high) / 2, rows, poles
    p_at, q_at = poles[rows, p], poles[rows, q]
    for _ in range(80):
        gone = own - mu[live, None]
        part = w / gone
        slope = part / gone
        psi, dpsi = np.einsum("ij,ij->i", part, side), np.einsum("ij,ij->i", slope, side)
        f, df = 1 + part.sum(axis=1), slope.sum(axis=1)
        here, beyond = mu[live], last[live]
        low[live], high[live] = np.where(f < 0, here, low[live]), np.where(f < 0, high[live], here)
        a_gap, b_gap = p_at[live] - here, q_at[live] - here
        turn = np.where(beyond, -1.0, 1.0)  # the last root lies beyond both of its poles
        a, b, c = turn * ((a_gap + b_gap) * f - a_gap * b_gap * df), a_gap * b_gap * f, f - a_gap * dpsi - b_gap * (df - dpsi)
        c = np.where(beyond, np.abs(c), c)
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        new = here + turn * np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        bad = ~((new > low[live]) & (new < high[live]))
        new = np.where(bad, (low[live] + high[live]) / 2, new)
        settled = (np.abs(new - here) <= 2 * EPS * np.abs(new)) | (np.abs(f) <= 4 * EPS * n * (1 + np.abs(psi) + np.abs(f - 1 - psi)))
        mu[live] = np.where(settled & bad, here, new)
        if settled.any():
            live = live[~settled]
            if not len(live):
                break
            own, side = own[~settled], side[~settled]
    return poles - mu[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, weight: float, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of Q diag(values) Q' + ``weight`` v v', for rising ``values`` and a weight of 0 or more."""
    z = vectors.T @ v * np.sqrt(weight)
    size = float(z @ z)
    if size == 0:
        return values, vectors
    with np.errstate(all="ignore"):
        return _changed(values, vectors, z, size)


def _changed(values: np.ndarray, vectors: np.ndarray, z: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    tol = 8 * EPS * max(float(np.abs(values).max()), size)
    d, q = values.copy(), vectors.copy()
    near = np.abs(z) * np.sqrt(size) <= tol  # the update doesn't touch these
    if (np.diff(d[~near]) <= tol / max(np.abs(z).max() ** 2, EPS) * size).any():
        last = -1
        for i in np.flatnonzero(~near).tolist():  # of (nearly) equal eigenvalues one direction takes the whole update
            if last >= 0:
                r = np.hypot(z[last], z[i])
                c, s = z[i] / r, z[last] / r
                if abs((d[i] - d[last]) * c * s) <= tol:
                    q[:, [last, i]] = np.stack((c * q[:, last] - s * q[:, i], s * q[:, last] + c * q[:, i]), axis=1)
                    d[last], d[i] = d[last] * c * c + d[i] * s * s, d[last] * s * s + d[i] * c * c
                    z[i], z[last], near[last] = r, 0.0, True
            last = i
    k = np.flatnonzero(~near)
    if not len(k):
        return values, vectors
    order = np.argsort(d[k], kind="stable")
    k = k[order]
    dk, zk = d[k], z[k]
    apart = secular_roots(dk, zk)  # d_j - root_i
    n = len(k)
    # z that has these roots exactly: eigenvectors stay orthogonal however close roots are
    ratio, between = np.ones((n, n)), dk[:, None] - dk[None]  # [i, j] = d_i - d_j
    _, _, _, i, j, k_, m = _shape(n)
    ratio[i, j] = -apart[i, j] / between[i, j]
    ratio[k_, m] = -apart[k_, m] / between[k_ + 1, m]
    ratio[n - 1] = -apart[n - 1]
    zk = np.sign(zk) * np.sqrt(np.abs(ratio.prod(axis=0)))
    new = zk[None] / apart
    new /= np.sqrt((new * new).sum(axis=1, keepdims=True))
    q[:, k] = q[:, k] @ new.T
    nearest = np.abs(apart).argmin(axis=1)
    d[k] = dk[nearest] - apart[np.arange(n), nearest]
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


@dataclass
class Spectrum:
    """Count, mean and spectrum of the scatter (the sum of centred squares) of some rows."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(0, np.zeros(dims), np.zeros(dims), np.eye(dims))

    def add(self, x: np.ndarray, times: int = 1) -> None:
        """A row, ``times`` times: one centred rank-one update."""
        gap, total = x - self.mean, self.n + times
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, self.n * times / total, gap)
        self.n, self.mean = total, self.mean + gap * (times / total)

    def merge(self, other: Spectrum) -> None:
        """The rows of both: a rank-one update for each direction of the other, and one for the means."""
        if not other.n:
            return
        total, gap = self.n + other.n, other.mean - self.mean
        if self.n:
            for value, v in zip(other.values, other.vectors.T, strict=True):
                if value > 0:
                    self.values, self.vectors = rank_one(self.values, self.vectors, float(value), v)
            self.values, self.vectors = rank_one(self.values, self.vectors, self.n * other.n / total, gap)
            self.mean = self.mean + gap * (other.n / total)
        else:
            self.mean, self.values, self.vectors = other.mean, other.values, other.vectors
        self.n = total

    def packed(self) -> bytes:
        return np.concatenate(([self.n], self.mean, self.values, self.vectors.ravel())).tobytes()

    @classmethod
    def unpacked(cls, data: bytes, dims: int) -> Spectrum:
        x = np.frombuffer(data)
        return cls(int(x[0]), x[1 : 1 + dims], x[1 + dims : 1 + 2 * dims], x[1 + 2 * dims :].reshape(dims, dims))


def _whole(vectors: DataFrame) -> DataFrame:
    """``id``, ``dims``, ``x`` (longs as bytes) of the rows that take part."""
    kind = vectors.schema["id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 2048):
            data, dims = [], []
            for v in b.column(1):
                x = None if not v.is_valid or v.values.null_count else np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                with np.errstate(over="ignore"):
                    x = np.floor(SCALE * x) if x is not None and len(x) and np.isfinite(x).all() else None
                good = x is not None and np.abs(x).max() < 1 << 50
                data.append((x.astype("<i8") + OFFSET).tobytes() if good else None)
                dims.append(len(x) if good else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], ["id", "dims", "x"])

    return vectors.mapInArrow(each, f"id {kind}, dims int, x binary").where("x is not null")


def _longs(b: pa.RecordBatch, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("x").to_pylist()), "<i8").reshape(b.num_rows, dims)


def _of_partitions(rows: DataFrame, start: Callable, add: Callable, finish: Callable) -> DataFrame:
    """One ``state`` for each partition that has rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, some = start(), False
        for b in small(batches, 2048):
            if b.num_rows:
                state, some = add(state, b), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([finish(state)], pa.binary())], ["state"])

    return rows.mapInArrow(each, "state binary")


def _combined(states: DataFrame, merge: Callable[[bytes, bytes], bytes], name: str) -> bytes:
    """All states as one: a tree of tasks, each of which combines ``FAN_IN`` or so; the driver gets the last one alone."""
    states = settle(states, name)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            for s in b.column(0).to_pylist():
                state = s if state is None else merge(state, s)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([state], pa.binary())], ["state"])

    while (n := states.count()) > 1:
        states = settle(states.repartition(max(1, n // FAN_IN)).mapInArrow(each, "state binary"), name)
    return states.first()[0]


def _sums(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], dims: int, name: str) -> np.ndarray:
    """The sum of a matrix of doubles over all rows."""
    add = lambda total, b: total + of(_longs(b, dims))
    both = lambda a, b: (np.frombuffer(a) + np.frombuffer(b)).tobytes()
    return np.frombuffer(_combined(_of_partitions(rows, lambda: 0.0, add, lambda t: t.tobytes()), both, name))


def _totals(rows: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """The number of rows and the exact sum of each dimension."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for b in small(batches, 2048):
            n += b.num_rows
            total = [a + int(s) for a, s in zip(total, _longs(b, dims).sum(axis=0), strict=True)] if b.num_rows else total
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str(t) for t in total]), pa.array([n] * dims, pa.int64())], ["dim", "total", "n"])

    sums = rows.mapInArrow(each, "dim int, total string, n long").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    found = sums.orderBy("dim").collect()  # a row a dimension
    return found[0]["n"], np.array([int(r["total"]) for r in found], object)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, from the exact numerator n * x - sums."""
    most = n * int(np.abs(x).max()) + max(abs(int(s)) for s in sums)
    exact = n * x - sums.astype(np.int64) if most < 1 << 63 else n * x.astype(object) - sums
    return exact.astype(np.float64) / n


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The exact sum of (n * x - sums)^2 of each row; null beyond a long."""
    most = n * int(np.abs(x).max()) + max(abs(int(s)) for s in sums)
    gap = n * x - sums.astype(np.int64) if most < 1 << 63 else n * x.astype(object) - sums
    widest = max(abs(int(gap.max())), abs(int(gap.min())))
    if widest * widest * x.shape[1] < 1 << 63:
        return (gap * gap).sum(axis=1).tolist()
    gap = gap.astype(object)
    return [s if s < 1 << 63 else None for s in (gap * gap).sum(axis=1).tolist()]


def whitened(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """For each row and component: ``id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Entries become x = floor(64 * c) + 1000000. ``n`` rows with sums S per dimension are the fit list:
    all rows that are returned, repeated ones as often as they occur. Components are unit eigenvectors
    of their covariance (divisor n), numbered from 1 by falling eigenvalue e; ``whitened`` is the
    centred row along the component over sqrt(e), ``explained`` e over the trace, ``identity_error``
    the largest entry of the covariance of ``whitened`` less the identity, ``deviation`` the exact sum
    of (n * x - S)^2, null beyond a long.

    Rows go whose vector is null, empty, or has null or non-finite entries, or entries so large that
    64 * c isn't a whole number below 2^50; and rows of another length than most (the lesser on ties). A
    null id stays. Components without variance (an eigenvalue under 1e-12 of the trace) are left out, as
    nothing can be divided by them: a constant or a single row gives no rows. An empty table gives none.
    """
    rows = _whole(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec")).where("vec is not null"))
    rows = settle(rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "longs")  # the updates are work by the row
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usual = rows.groupBy("dims").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "dims").first()
    if usual is None:
        return rows.sparkSession.createDataFrame([], schema)
    dims = usual["dims"]
    rows = rows.where(F.col("dims") == dims)
    n, sums = _totals(rows, dims)

    def add(state: Spectrum, b: pa.RecordBatch) -> Spectrum:
        x, times = np.unique(_longs(b, dims), axis=0, return_counts=True)
        for row, k in zip(x.astype(np.float64), times.tolist(), strict=True):
            state.add(row, k)
        return state

    def both(a: bytes, b: bytes) -> bytes:
        one = Spectrum.unpacked(a, dims)
        one.merge(Spectrum.unpacked(b, dims))
        return one.packed()

    first = _combined(_of_partitions(rows, lambda: Spectrum.empty(dims), add, Spectrum.packed), both, "spectra")
    basis, _ = np.linalg.qr(Spectrum.unpacked(first, dims).vectors)

    def ritz(x: np.ndarray) -> np.ndarray:
        y = _centred(x, n, sums) @ basis
        return (y.T @ y).ravel()

    values, turn = np.linalg.eigh(_sums(rows, ritz, dims, "ritz").reshape(dims, dims) / n)
    trace = float(values.sum())
    keep = [k for k in np.argsort(-values, kind="stable")[:components].tolist() if values[k] > 1e-12 * trace]
    if not keep:
        return rows.sparkSession.createDataFrame([], schema)
    to_white = basis @ turn[:, keep] / np.sqrt(values[keep])
    explained = values[keep] / trace

    def moments(x: np.ndarray) -> np.ndarray:
        w = _centred(x, n, sums) @ to_white
        return np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))

    found, m = _sums(rows, moments, dims, "moments") / n, len(keep)
    error = float(np.abs(found[m:].reshape(m, m) - np.outer(found[:m], found[:m]) - np.eye(m)).max())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 2048):
            x = _longs(b, dims)
            at = np.repeat(np.arange(len(x)), m)
            deviation = pa.array(_deviations(x, n, sums), pa.int64())
            data = [b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), n)), deviation.take(pa.array(at))]
            data += [pa.array((_centred(x, n, sums) @ to_white).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(at), error))]
            yield pa.RecordBatch.from_arrays(data, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(each, schema)
