"""Hard negatives, graph search and whitening against brute force, and their edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import ann, hard_negatives, queries, whitening
from fathomline.llm.hard_negatives import Side

SCHEMA = "vec_id long, embedding array<double>, label int, id long, score string, dims int"
ODD = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [0.0] * 7]


def table(spark, rows):
    """Vectors with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, v, y, 5, "s", 2) for i, v, y in rows], SCHEMA)


def vectors(seed, n, dims=8, clusters=6, spread=0.3):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((clusters, dims))
    return [(centres[k % clusters] + spread * rnd.standard_normal(dims)).round(3).tolist() for k in range(n)]


def finite(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)


def plain_negatives(rows, positives=5, negatives=10):
    rows = list(dict.fromkeys((i, tuple(math.floor(256 * c) for c in v), y) for i, v, y in rows if i is not None and y is not None and finite(v)))
    out = []
    for a in rows:
        if a[0] % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(a[1], b[1], strict=True)), b[0], b[2]) for b in rows if b[0] != a[0] and len(b[1]) == len(a[1]))
        for p, i, _ in [s for s in scored if s[2] == a[2]][:positives]:
            fit = [s for s in scored if s[2] != a[2] and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            out += [(a[0], i, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.05, 0.3, 3.0])
def test_hard_negatives(spark, spread):
    rnd = random.Random(1)
    rows = [(i, v, rnd.randrange(4)) for i, v in enumerate(vectors(2, 700, spread=spread))]
    rows += [(1000 + i, rows[100][1], i % 2) for i in range(40)]  # copies, with ties
    rows += [(2000 + i, v, 1) for i, v in enumerate(ODD)] + [(2100, [1.0, 2.0], 1), (2101, [2.0, 2.0], 1), (2102, [1.0, 1.0], 0), (None, [1.0] * 8, 1), (2200, [1.0] * 8, None), rows[5], rows[100], (300, [0.5] * 8, 2)]
    rows += [(2300, [1e6] * 8, 1), (2301, [1e6] * 8, 1), (2302, [5e5] * 8, 2), (2303, [1e300] * 8, 2)]  # the last is out of range
    got = sorted(map(tuple, hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0, block=64).collect()))
    got = [(a, p, k, n, ps, ns) for a, p, k, n, ps, ns in got]
    assert got == plain_negatives([r for r in rows if r[0] != 2303])


def test_hard_negatives_edges(spark):
    none = table(spark, [])
    assert hard_negatives.hard_negatives(none, F.col("vec_id") % 100 == 0).count() == 0
    alone = table(spark, [(100, [1.0] * 8, 1), (100, [1.0] * 8, 1)])
    assert hard_negatives.hard_negatives(alone, F.col("vec_id") % 100 == 0).collect() == []
    low = table(spark, [(100, [1.0] * 8, 1), (1, [-1.0] * 8, 1), (2, [-0.5] * 8, 2)])  # a negative positive score: an empty window
    assert hard_negatives.hard_negatives(low, F.col("vec_id") % 100 == 0).collect() == []
    zero = table(spark, [(100, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 3.0], 2)])
    assert [tuple(r) for r in hard_negatives.hard_negatives(zero, F.col("vec_id") % 100 == 0).collect()] == [(100, 1, 1, 2, 0, 0)]


def test_bounds_hold_and_skip():
    """No row within a window lies outside of the ranges, and on clustered vectors most rows are never scored."""
    x = np.array(vectors(5, 4000, 16, 40, 0.05))
    x = np.floor(256 * x)
    norms = np.sqrt((x * x).sum(axis=1))
    references = x[:40] / norms[:40, None]  # one of each cluster
    every = hard_negatives.angles(x, norms, references)
    cell = every.argmin(axis=1)
    anchors = Side(np.arange(50), np.zeros(50), x[:50].astype("<i4"), every[:50], norms[:50])
    exact, scored = x[:50] @ x.T, 0
    low, high = np.full(50, 0.6 * np.median(norms) ** 2), np.full(50, 0.9 * np.median(norms) ** 2)
    for c in np.unique(cell):
        at = np.flatnonzero(cell == c)
        at = at[np.argsort(every[at, c], kind="stable")]
        rows = Side(at, np.zeros(len(at)), x[at].astype("<i4"), every[at], norms[at], int(c))
        may, first, last = hard_negatives.overlapping(anchors, rows, low, high)
        inside = (np.arange(len(at))[None] >= first[:, None]) & (np.arange(len(at))[None] < last[:, None]) & may[:, None]
        within = (exact[:, at] >= low[:, None]) & (exact[:, at] <= high[:, None])
        assert not (within & ~inside).any()
        scored += inside.sum()
    assert scored < 0.5 * exact.size


def plain_neighbours(rows, ids, k=10):
    rows = list(dict.fromkeys((i, tuple(v)) for i, v, _ in rows if i is not None and finite(v) and any(v)))
    out = []
    for a in rows:
        if a[0] in ids:
            near = sorted((math.dist(a[1], b[1]), b[0]) for b in rows if b[0] != a[0] and len(a[1]) == len(b[1]))[:k]
            out += [(a[0], i, round(d, 9), n + 1) for n, (d, i) in enumerate(near)]
    return sorted(out)


def test_graph_search_finds_all_of_a_small_table(spark):
    rows = [(i, v, 0) for i, v in enumerate(vectors(7, 600))]
    rows += [(1000 + i, rows[3][1], 0) for i in range(200)]  # a third are copies
    rows += [(2000 + i, v, 1) for i, v in enumerate(ODD)] + [(2100, [1.0, 2.0], 1), (2101, [2.0, 2.0], 1), (None, [1.0] * 8, 1), rows[100], (3, rows[3][1], 0)]
    ids = {*range(0, 600, 50), 3, 1005, 2000, 2002, 2100, None}
    t = table(spark, rows)
    asked = t.where("vec_id % 50 = 0 and vec_id < 600 or vec_id in (3, 1005, 2000, 2002, 2100) or vec_id is null")
    got = sorted((r[0], r[1], round(r[2], 9), r[3]) for r in ann.nearest_neighbours(t, asked).collect())
    assert got == plain_neighbours(rows, ids)
    assert ann.nearest_neighbours(table(spark, []), asked).count() == 0
    assert ann.nearest_neighbours(t, table(spark, [])).count() == 0


def test_graph_recall():
    """A shard of its own size: recall of at least 0.95 on spread and on clustered vectors, every node reachable."""
    for dims, clusters, spread in ((64, 1, 1.0), (32, 50, 0.2)):
        x = np.array(vectors(11, 6000, dims, clusters, spread))
        heights = np.sort(np.minimum(np.floor(-np.log(np.random.default_rng(3).random(6000)) / math.log(16)), 12).astype(int))[::-1]
        graph = ann.Graph.build(x, heights)
        q = x[::60]
        found = graph.search(q, ann.BREADTH)
        true = np.argsort(((q[:, None] - x[None]) ** 2).sum(axis=2), axis=1)[:, :10]
        assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(true.tolist(), found.tolist(), strict=True)]) >= 0.95
        assert len(graph.loose) < 60


def test_exact_distance_of_large_numbers():
    q, x = np.array([[1e200, 0.0], [3.0, 4.0]]), np.array([[-1e200, 0.0], [0.0, 0.0]])
    assert ann.exact_distance(q, x).tolist() == [2e200, 5.0]


def plain_whitening(rows, components):
    kept = [(i, v) for i, v, _ in rows if finite(v)]
    lengths = [len(v) for _, v in kept]
    usual = min(sorted(set(lengths)), key=lambda d: (-lengths.count(d), d))
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in kept if len(v) == usual]
    n, x = len(kept), np.array([v for _, v in kept])
    sums = x.sum(axis=0)
    centred = (n * x - sums) / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    return kept, n, ((n * x - sums) ** 2).sum(axis=1), centred @ turn[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening(spark):
    rows = [(i, v, 0) for i, v in enumerate(vectors(13, 500, 40, 5, 0.5))]
    rows += [rows[7]] * 3 + [(None, rows[9][1], 0), (900, [1.0] * 8, 0)] + [(2000 + i, v, 1) for i, v in enumerate(ODD) if i != 2] + [(901, [1e300] + [0.0] * 39, 0)]
    kept, n, deviation, white, explained = plain_whitening([r for r in rows if r[0] != 901], 32)
    got = whitening.whitened(table(spark, rows)).collect()
    assert len(got) == 32 * n and {r["n"] for r in got} == {n}
    place = {i: k for k, (i, _) in enumerate(kept)}
    signs = {}
    for r in got:
        k, c = place[r["id"]], r["component"] - 1
        assert r["deviation"] == deviation[k]
        assert abs(r["explained"] - explained[c]) < 1e-9 and r["identity_error"] < 1e-9
        if abs(white[k, c]) > 0.5:
            assert signs.setdefault(c, np.sign(r["whitened"] * white[k, c])) == np.sign(r["whitened"] * white[k, c])
        assert abs(abs(r["whitened"]) - abs(white[k, c])) < 1e-8


def test_whitening_edges(spark):
    assert whitening.whitened(table(spark, [])).count() == 0
    assert whitening.whitened(table(spark, [(1, None, 0), (2, [], 0)])).count() == 0
    assert whitening.whitened(table(spark, [(1, [1.0, 2.0], 0)] * 3)).count() == 0  # no variance
    flat = whitening.whitened(table(spark, [(i, [float(i), 2.0 * i, 5.0], 0) for i in range(20)])).collect()  # rank one
    assert len(flat) == 20 and {r["component"] for r in flat} == {1} and flat[0]["explained"] == pytest.approx(1)


def test_spectra_of_updates_and_merges():
    rnd = np.random.default_rng(3)
    for dims in (1, 2, 5, 24):
        for x in (rnd.integers(0, 3, (90, dims)).astype(float), 1e6 + 8 * rnd.standard_normal((200, dims)), np.repeat(rnd.standard_normal((3, dims)), 9, axis=0)):
            a, b = whitening.Spectrum.empty(dims), whitening.Spectrum.empty(dims)
            for k, row in enumerate(x):
                (a if k % 3 else b).add(row, 1 + k % 2)
            a.merge(b)
            full = np.repeat(x, [1 + k % 2 for k in range(len(x))], axis=0)
            centred = full - full.mean(axis=0)
            size = max(1.0, np.abs(centred.T @ centred).max())
            assert a.n == len(full) and np.abs(a.vectors * a.values @ a.vectors.T - centred.T @ centred).max() < 1e-8 * size
            assert np.abs(a.vectors.T @ a.vectors - np.eye(dims)).max() < 1e-12


def test_queries_ask_for_the_contract(spark, sf):
    found = queries.op13_whitening(spark, sf)
    assert {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"} <= set(found.columns)
    assert dict(found.dtypes)["component"] == "int" and dict(queries.op12_ann_search(spark, sf).dtypes)["rank"] == "int"
