"""Walks within zones, expansion with edges and paths, and joins of similar sets, against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fathomline.operators import graph, lexical
from fathomline.plans import retrieval

EDGES = "src string, dst string, edge_type string, zone string"


def test_zone_of_the_edge_that_was_walked(spark):
    """A node takes the zone of the edge on the way, and no way leads through a zone that is left out."""
    edges = spark.createDataFrame([("a", "b", "x", "entity"), ("c", "b", "x", "data"), ("a", "d", "x", "provenance"), ("d", "f", "x", "entity")], EDGES)
    start = spark.createDataFrame([("a",)], "start string")
    got = {(r["node"], r["zone"], r["depth"]) for r in retrieval.related(start, edges, zones=["entity", "data"]).collect()}
    assert got == {("b", "entity", 1)}
    got = {(r["node"], r["zone"], r["depth"]) for r in retrieval.related(start, edges).collect()}
    assert got == {("b", "entity", 1), ("d", "provenance", 1), ("f", "entity", 2)}


def plain_walk(start, edges, depth, zones):
    best, front = {start: (0, [start])}, {start: [start]}
    for step in range(1, depth + 1):
        new = defaultdict(list)
        for x, path in front.items():
            for a, b, _, z in edges:
                if a == x and (zones is None or z in zones):
                    new[b].append([*path, b])
        front = {x: min(p) for x, p in new.items() if x not in best}
        best |= {x: (step, p) for x, p in front.items()}
    return best


def test_expansion(spark):
    rnd = random.Random(2)
    zones = ["entity", "data", "knowledge", "provenance"]
    edges = list({(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}", rnd.choice("xy"), rnd.choice(zones)) for _ in range(90)})
    props = lambda i: {"metric": f"m{i}", "value": str(i)} if i % 2 else {"metric": "m"}
    nodes = [(f"n{i}", zones[i % 4], "kind", f"label {i}", props(i)) for i in range(29)]
    table, all_nodes = spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, "node string, zone string, node_type string, label string, props map<string,string>")
    asked = [("q1", "n1", ["entity", "data"]), ("q1", "n2", ["entity", "data"]), ("q2", "n1", None), ("q3", "none", ["data"])]
    got = graph.expand(spark.createDataFrame(asked, "start string, node string, zones array<string>"), all_nodes, table, 3)
    alone = [a for a in asked if a[0] != "q1"]
    known = {n[0]: n for n in nodes}
    for q, node, within in alone:
        want = plain_walk(node, edges, 3, within)
        rows = {r["node"]: (r["depth"], r["path"]) for r in got.nodes.where(F.col("start") == q).collect()}
        assert rows == {x: v for x, v in want.items() if x in known}
        used = Counter((r["src"], r["dst"], r["edge_type"], r["zone"]) for r in got.edges.where(F.col("start") == q).collect())
        assert used == Counter(e for e in edges if e[0] in want and want[e[0]][0] < 3 and (within is None or e[3] in within))
        full = sorted(r["path"] for r in got.paths.where(F.col("start") == q).collect())
        assert full == sorted(p for d, p in want.values() if d == 3)
        texts = {r["node"]: r["text"] for r in got.texts.where(F.col("start") == q).collect()}
        told = {}
        for x in want:
            if x in known and known[x][1] == "knowledge":
                told[x] = known[x][3]
            elif x in known and known[x][1] == "data" and "value" in known[x][4]:
                told[x] = f"Metric={known[x][4]['metric']}; Period=; Value={known[x][4]['value']}"
        assert texts == told
        assert {r["node"] for r in got.zone("data").where(F.col("start") == q).collect()} == {x for x in want if x in known and known[x][1] == "data"}
    both = {r["node"]: r["depth"] for r in got.nodes.where("start = 'q1'").collect()}
    one, two = (plain_walk(n, edges, 3, ["entity", "data"]) for n in ("n1", "n2"))
    assert both == {x: min(w[x][0] for w in (one, two) if x in w) for x in {*one, *two} if x in known}


def names(seed, n):
    rnd = random.Random(seed)
    syllables = [a + b for a in "bcdfglmnprst" for b in "aeiou"]
    words = ["".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4))) for _ in range(400)]
    out = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 4))) + rnd.choice([" inc", " corp", ""]) for _ in range(n)]
    return out + [x[:-1] + "x" for x in out[: n // 3]] + ["", None, "a", out[0]]


def trigrams(x):
    x = "  " + x.lower() + " "
    return {x[i : i + 3] for i in range(len(x) - 2)}


@pytest.mark.parametrize("least", [0.1, 0.5, 0.8, 1.0])
def test_similar_sets_by_prefixes(spark, least):
    left, right = names(1, 120), names(2, 90) + names(1, 120)[:60]
    one, two = (spark.createDataFrame([(x,) for x in v], f"{c} string") for v, c in ((left, "a"), (right, "b")))
    got = {(r["a"], r["b"]): r["sim"] for r in lexical.trigram_pairs(one, two, "a", "b", least).collect()}
    want = {}
    for x in {x for x in left if x is not None}:
        for y in {y for y in right if y is not None}:
            s, t = trigrams(x), trigrams(y)
            sim = round(len(s & t) / len(s | t), 6)
            if sim >= least and s & t:
                want[x, y] = sim
    assert got == pytest.approx(want)


def test_few_candidates_are_compared(spark):
    """At a similarity of 0.6: under a tenth of the pairs that share a trigram."""
    sets = lexical._gram_sets(spark.createDataFrame([(x,) for x in names(3, 600)], "a string"), "a")
    ranks = sets.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("f")).select("gram", F.struct("f", "gram").alias("no"))
    ordered = lexical._rare_first(sets, ranks).cache()
    grams = ordered.select("value", F.explode("nos").alias("no"))
    sharing = grams.join(grams.withColumnRenamed("value", "other"), "no").select("value", "other").distinct().count()
    assert lexical.candidates(ordered, ordered, 0.6).count() < 0.1 * sharing
