"""Modularity communities by rounds of local moves and contraction, over edge tables of any size.

A level: nodes move to the neighbouring community that raises modularity most. Many move at once: first
the half of the improving nodes that a hash of node and round picks; where that doesn't raise
modularity, those moves that are the best of both communities they touch. The latter share no
community, so their gains add up exactly, and the best move of all is among them: modularity
never falls. Then communities become the nodes of a smaller weighted graph, and the next level begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle

#: Gains below this are none.
LEAST = 1e-9


def undirected(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``src`` <= ``dst``, ``w``: one edge for each pair, whatever its direction; weights are added, or 1 without them."""
    pairs = edges.where("src is not null and dst is not null").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col(weight).cast("double").alias("w") if weight else F.lit(1.0).alias("w"))
    return pairs.groupBy("src", "dst").agg((F.sum("w") if weight else F.max("w")).alias("w"))


def _both(edges: DataFrame) -> DataFrame:
    """``u``, ``v``, ``w`` in both directions; a loop once, with twice its weight, as it counts in a degree."""
    once = edges.where("src <> dst")
    loops = edges.where("src = dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), (2 * F.col("w")).alias("w"))
    return once.select(F.col("src").alias("u"), F.col("dst").alias("v"), "w").unionByName(once.select(F.col("dst").alias("u"), F.col("src").alias("v"), "w")).unionByName(loops)


def _modularity(both: DataFrame, degrees: DataFrame, labels: DataFrame, m: float, resolution: float) -> float:
    """``labels``: node, label. ``both`` has each edge twice, so that the sums are over 2m."""
    a, b = labels.toDF("u", "la"), labels.toDF("v", "lb")
    inside = both.join(a, "u").join(b, "v").where("la = lb").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("inside"))
    squares = degrees.join(labels, "node").groupBy("label").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("squares"))
    row = inside.crossJoin(squares).first()  # one row each
    return row["inside"] / (2 * m) - resolution * row["squares"] / (4 * m * m)


def _moves(both: DataFrame, degrees: DataFrame, labels: DataFrame, m: float, resolution: float) -> DataFrame:
    """``node``, ``label``, ``to``, ``gain``: the best move of each node that raises modularity; the lesser label on ties."""
    state = labels.join(degrees, "node")
    totals = state.groupBy("label").agg(F.sum("k").alias("total"), F.count("*").alias("size"))
    near = both.where("u <> v").join(labels.toDF("v", "to"), "v").groupBy("u", "to").agg(F.sum("w").alias("w"))
    rows = near.join(state.withColumnRenamed("node", "u"), "u").join(totals.toDF("to", "total", "size"), "to")
    own = F.col("label") == F.col("to")
    value = F.col("w") / m - resolution * F.col("k") * (F.col("total") - F.when(own, F.col("k")).otherwise(0.0)) / (2 * m * m)
    rows = rows.withColumn("value", value)
    # Staying is worth what the own community gives, which has no row where the node has no neighbour in it.
    home = totals.toDF("label", "home", "home_size")
    best = rows.groupBy("u").agg(F.max(F.when(own, F.col("value"))).alias("stay"), F.max(F.when(~own, F.struct("value", F.lit(0).alias("_"))))["value"].alias("value"), F.first("label").alias("label"), F.first("k").alias("k"))
    best = best.where("value is not null").join(home, "label")
    best = best.withColumn("stay", F.coalesce("stay", -resolution * F.col("k") * (F.col("home") - F.col("k")) / (2 * m * m)))
    best = best.select("u", "label", "home_size", (F.col("value") - F.col("stay")).alias("gain"), F.col("value").alias("best")).where(F.col("gain") > LEAST)
    to = rows.where(~own).join(best.select("u", "best"), "u").where("value = best").groupBy("u").agg(F.min(F.struct("to", "size")).alias("t"))
    found = best.join(to, "u").where(~((F.col("home_size") == 1) & (F.col("t.size") == 1) & (F.col("t.to") > F.col("label"))))  # two alone don't swap
    return found.select(F.col("u").alias("node"), "label", F.col("t.to").alias("to"), "gain")


def _apart(moves: DataFrame) -> DataFrame:
    """The moves that are the best of both communities that they touch."""
    order = F.struct(F.col("gain"), F.xxhash64("node").alias("h"), F.col("node"))
    touched = moves.select(F.explode(F.array("label", "to")).alias("at"), order.alias("o")).groupBy("at").agg(F.max("o").alias("o"))
    rows = moves.withColumn("mine", order)
    for side in ("label", "to"):
        rows = rows.join(touched.select(F.col("at").alias(side), F.col("o").alias(f"best_{side}")), side)
    return rows.where("mine = best_label and mine = best_to").select("node", "label", "to", "gain")


def _moved(labels: DataFrame, moves: DataFrame) -> DataFrame:
    return labels.join(moves.select("node", "to"), "node", "left").select("node", F.coalesce("to", "label").alias("label"))


def _level(edges: DataFrame, m: float, resolution: float, rounds: int, least: float) -> tuple[DataFrame, float]:
    """Labels of the nodes after up to ``rounds`` rounds of moves, and their modularity; it starts with each node alone."""
    both = settle(_both(edges), "both")
    degrees = settle(both.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k")), "degrees")
    labels = settle(degrees.select("node", F.col("node").alias("label")), "labels")
    now = _modularity(both, degrees, labels, m, resolution)
    for round_ in range(rounds):
        moves = settle(_moves(both, degrees, labels, m, resolution), "moves")
        some = moves.where(F.pmod(F.xxhash64("node", F.lit(round_)), F.lit(2)) == 0)
        found = settle(_moved(labels, some), "labels")
        then = _modularity(both, degrees, found, m, resolution)
        if then <= now + LEAST:
            apart = _apart(moves)
            found = settle(_moved(labels, apart), "labels")
            then = _modularity(both, degrees, found, m, resolution)
            if then <= now + LEAST:  # no move is left
                break
        gained, labels, now = then - now, found, then
        if gained < least:
            break
    return labels, now


def levels(edges: DataFrame, *, weight: str | None = None, resolution: float = 1.0, rounds: int = 20, most: int = 20, least: float = 1e-6) -> list[tuple[DataFrame, float]]:
    """For each level, ``node``, ``community`` (the least node in it) of the first graph's nodes, and the modularity.

    Each level's modularity is at least that of the level before. The last level is the one after
    which moves of whole communities gain less than ``least``. An edge table without edges has none.
    """
    graph = settle(undirected(edges, weight), "graph")
    m = graph.agg(F.sum("w")).first()[0]
    if not m:
        return []
    out: list[tuple[DataFrame, float]] = []
    whole = None
    for _ in range(most):
        labels, q = _level(graph, m, resolution, rounds, least)
        whole = labels if whole is None else settle(whole.join(labels.toDF("label", "new"), "label").select("node", F.col("new").alias("label")), "whole")
        if out and q < out[-1][1] + least:
            break
        names = whole.groupBy("label").agg(F.min("node").alias("community"))
        out.append((settle(whole.join(names, "label").select("node", "community"), "communities"), q))
        a, b = labels.toDF("src", "la"), labels.toDF("dst", "lb")
        joined = graph.join(a, "src").join(b, "dst")
        graph = settle(joined.groupBy(F.least("la", "lb").alias("src"), F.greatest("la", "lb").alias("dst")).agg(F.sum("w").alias("w")), "graph")
    return out


def louvain(edges: DataFrame, *, nodes: DataFrame | None = None, weight: str | None = None, resolution: float = 1.0) -> DataFrame:
    """``node``, ``community``: the communities of the last level, named by their least node.

    Directions don't count, and edges between the same nodes are one (with ``weight``: their sum). Nodes
    (``node``) without edges are communities of their own. The same edges give the same communities,
    in whatever order or partitions they lie, but for rounding of weights that aren't whole numbers.
    """
    found = levels(edges, weight=weight, resolution=resolution)
    kind = edges.schema["src"].dataType.simpleString()
    rows = found[-1][0] if found else edges.sparkSession.createDataFrame([], f"node {kind}, community {kind}")
    if nodes is None:
        return rows
    alone = nodes.select("node").where("node is not null").distinct().join(rows, "node", "left_anti")
    return rows.unionByName(alone.select("node", F.col("node").alias("community")))
