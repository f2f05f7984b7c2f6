"""Modularity communities against a plain sequential run, on graphs with and without structure."""

import random
from collections import defaultdict

import pytest

from fathomline.operators import communities, graph


def planted(seed, groups, size, inside, outside):
    rnd = random.Random(seed)
    n = groups * size
    return [(a, b) for a in range(n) for b in range(a + 1, n) if rnd.random() < (inside if a // size == b // size else outside)]


def plain_modularity(edges, label, resolution=1.0):
    m = sum(w for _, _, w in edges)
    inside, total = defaultdict(float), defaultdict(float)
    for a, b, w in edges:
        total[label[a]] += w
        total[label[b]] += w
        if label[a] == label[b]:
            inside[label[a]] += w
    return sum(inside[c] / m - resolution * (total[c] / (2 * m)) ** 2 for c in total)


def plain_louvain(edges):
    """One node after another, in order, as long as anything gains; then communities as nodes."""
    names, graph_ = {x: x for e in edges for x in e[:2]}, list(edges)
    while True:
        near, degree, m = defaultdict(lambda: defaultdict(float)), defaultdict(float), sum(w for _, _, w in graph_)
        for a, b, w in graph_:
            degree[a] += w
            degree[b] += w
            if a != b:
                near[a][b] += w
                near[b][a] += w
        label, total, moved = {x: x for x in degree}, dict(degree), True
        while moved:
            moved = False
            for x in sorted(degree):
                to = defaultdict(float)
                for y, w in near[x].items():
                    to[label[y]] += w
                total[label[x]] -= degree[x]
                gain = lambda c: to[c] / m - degree[x] * total[c] / (2 * m * m)  # noqa: B023, E731
                best = max(to, key=lambda c: (gain(c), -c), default=label[x])
                if gain(best) > gain(label[x]) + 1e-12:
                    label[x], moved = best, True
                total[label[x]] += degree[x]
        if len(set(label.values())) == len(label):
            return names
        names = {x: label[y] for x, y in names.items()}
        grown = defaultdict(float)
        for a, b, w in graph_:
            grown[tuple(sorted((label[a], label[b])))] += w
        graph_ = [(a, b, w) for (a, b), w in grown.items()]


@pytest.mark.parametrize("edges", [planted(1, 6, 12, 0.7, 0.03), planted(2, 1, 60, 0.1, 0.0), [(i, (i + 1) % 40) for i in range(40)] + [(100, i) for i in range(0, 40, 5)]], ids=["planted", "random", "ring"])
def test_modularity_is_that_of_a_plain_run(spark, edges):
    found = communities.levels(spark.createDataFrame([(b, a) if k % 3 else (a, b) for k, (a, b) in enumerate(edges)] + edges[:5], "src long, dst long"))
    weighted = [(a, b, 1.0) for a, b in edges]
    scores = []
    for rows, q in found:
        label = dict(map(tuple, rows.collect()))
        assert set(label) == {x for e in edges for x in e} and all(label[c] == c and c <= x for x, c in label.items())
        assert q == pytest.approx(plain_modularity(weighted, label), abs=1e-9)
        scores.append(q)
    assert scores == sorted(scores)
    assert scores[-1] >= 0.98 * plain_modularity(weighted, plain_louvain(weighted))


def test_weights_loops_and_lone_nodes(spark):
    edges = [(1, 2, 5.0), (2, 1, 1.0), (3, 4, 6.0), (2, 3, 0.5), (4, 4, 2.0), (None, 3, 1.0)]
    nodes = spark.createDataFrame([(1,), (9,), (None,)], "node long")
    got = dict(map(tuple, communities.louvain(spark.createDataFrame(edges, "src long, dst long, w double"), nodes=nodes, weight="w").collect()))
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 9: 9}
    none = spark.createDataFrame([], "src long, dst long")
    assert communities.louvain(none).count() == 0
    assert [tuple(r) for r in communities.louvain(none, nodes=nodes).collect() if r[0] != 1] == [(9, 9)]


def plain_propagation(edges, rounds):
    near = defaultdict(list)
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    label = {x: x for x in near}
    for _ in range(rounds):
        label = {x: min(set(votes), key=lambda c: (-votes.count(c), c)) for x, ys in near.items() for votes in [[label[y] for y in ys]]}
    return label


@pytest.mark.parametrize("rounds", [1, 4, 9, 10])
def test_label_propagation_stops_as_if_it_went_on(spark, rounds):
    """A pair swings for ever, a triangle settles."""
    for edges in ([(1, 2), (5, 6), (6, 7), (7, 5)], planted(3, 3, 5, 0.9, 0.05)):
        got = dict(map(tuple, graph.label_propagation(spark.createDataFrame(edges, "src long, dst long"), rounds).collect()))
        assert got == plain_propagation(edges, rounds)
