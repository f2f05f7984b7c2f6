"""A property graph as node and edge tables: upkeep, traversal, communities."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import community_id
from ..sources.scratch import settle
from .ranking import ranked, ranked_by_ranges, top_k

#: Node and edge types of each zone.
ZONES = {
    "entity": (
        ("company", "subsidiary", "executive", "product", "regulator", "ticker", "exchange", "investor", "industry", "sector"),
        ("has_subsidiary", "employed_by", "produces", "regulated_by", "listed_on", "competes_with", "invested_in", "belongs_to_sector", "belongs_to_industry"),
    ),
    "data": (
        ("financial_fact", "ratio", "guidance", "time_series"),
        ("has_fact", "has_ratio", "gave_guidance", "fact_for_period"),
    ),
    "knowledge": (
        ("claim", "event", "risk", "guidance_change", "analyst_opinion"),
        ("acquired", "merged_with", "partnered_with", "divested", "mentioned_in_claim", "impacts", "revised_guidance", "risk_affects"),
    ),
    "lexical": (
        ("alias", "abbreviation", "translation", "domain_synonym", "schema_mapping"),
        ("alias_of", "abbreviates", "translates", "synonym_of", "maps_to_concept"),
    ),
    "provenance": (
        ("document", "extraction_run", "embedding_run", "model", "system"),
        ("derived_from", "wasGeneratedBy", "used", "wasAttributedTo", "wasAssociatedWith"),
    ),
}


def unknown_types(edges: DataFrame) -> DataFrame:
    """Edge types that their zone doesn't know, with how many edges have them."""
    known = F.lit(False)
    for zone, (_, kinds) in ZONES.items():
        known = known | ((F.col("zone") == zone) & F.col("edge_type").isin(*kinds))
    return edges.where(~known).groupBy("zone", "edge_type").agg(F.count("*").alias("n"))


def traverse(starts: DataFrame, edges: DataFrame, depth: int, *, edge_types: list[str] | None = None, zones: list[str] | None = None) -> DataFrame:
    """``start``, ``node``, ``depth``: all that each of many starts reaches by out-edges, at its least depth.

    One join for each step, for all starts at once; what was seen is left out, so the rows are at
    most the pairs reached. Each step is a table in the shared folder.
    """
    if edge_types:
        edges = edges.where(F.col("edge_type").isin(edge_types))
    if zones:
        edges = edges.where(F.col("zone").isin(zones))
    seen = front = starts.select(F.col("node").alias("start"), "node", F.lit(0).cast("long").alias("depth")).distinct()
    for step in range(1, depth + 1):
        found = front.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("start", F.col("dst").alias("node")).distinct()
        front = settle(found.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(step).cast("long")), "frontier")
        seen = seen.unionByName(front)
    return seen


def walk(starts: DataFrame, edges: DataFrame, depth: int, *, edge_types: list[str] | None = None) -> DataFrame:
    """``start``, ``node``, ``depth``, ``edge_zone``, ``path``: what each start reaches by out-edges, and one way there.

    ``starts`` has ``start`` (any name of the walk), ``node`` and, if walks differ in it, ``zones``, the
    zones of edges that the walk may use (null: all). A node is reached at its least depth; of several
    shortest ways the path (an array of nodes) is the least. Many walks share each step's join; what
    a walk has seen is left out, so the rows are at most the pairs reached.
    """
    if edge_types:
        edges = edges.where(F.col("edge_type").isin(edge_types))
    zones = F.col("zones") if "zones" in starts.columns else F.lit(None).cast("array<string>")
    first = starts.select("start", "node", zones.alias("zones"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("edge_zone"), F.array("node").alias("path"))
    seen = front = settle(first.dropDuplicates(["start", "node"]), "frontier")
    out = edges.select(F.col("src").alias("node"), "dst", F.col("zone").alias("via")).distinct()
    for step in range(1, depth + 1):
        met = front.join(out, "node").where(F.col("zones").isNull() | F.array_contains("zones", F.col("via")))
        found = met.groupBy("start", F.col("dst").alias("node")).agg(F.min(F.struct(F.concat("path", F.array("dst")).alias("path"), F.col("via").alias("edge_zone"))).alias("way"), F.first("zones").alias("zones"))
        found = found.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        front = settle(found.select("start", "node", "zones", F.lit(step).cast("long").alias("depth"), "way.edge_zone", "way.path"), "frontier")
        seen = seen.unionByName(front)
    return seen.drop("zones")


class Expansion(NamedTuple):
    """``nodes`` (start, node, depth, path and the node's columns), ``edges`` (start, depth and the edge's columns), ``paths`` (start, path), ``texts`` (start, node, text)."""

    nodes: DataFrame
    edges: DataFrame
    paths: DataFrame
    texts: DataFrame

    def zone(self, name: str) -> DataFrame:
        """Nodes of one zone: entities, facts (data), claims (knowledge) or provenance."""
        return self.nodes.where(F.col("zone") == name)


def expand(starts: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2, *, edge_types: list[str] | None = None) -> Expansion:
    """What walk() reaches, with the edges of every node that is walked on from, and paths of full depth.

    ``nodes`` is (node, zone, node_type, label, props); reached nodes without a row there have no row.
    Facts give a text of their metric, period and value, where they have a metric and a value; claims
    their label. Edges are those that the walk may use.
    """
    reached = settle(walk(starts, edges, depth, edge_types=edge_types), "reached")
    known = settle(reached.drop("edge_zone").join(nodes, "node"), "expanded")
    usable = edges.where(F.col("edge_type").isin(edge_types)) if edge_types else edges
    walked = reached.where(F.col("depth") < depth).select("start", "depth", F.col("node").alias("src")).join(usable, "src")
    if "zones" in starts.columns:
        walked = walked.join(starts.select("start", "zones").distinct(), "start").where(F.col("zones").isNull() | F.array_contains("zones", F.col("zone"))).drop("zones")
    get = lambda k: F.element_at("props", F.lit(k))
    fact = F.concat(F.lit("Metric="), get("metric"), F.lit("; Period="), F.coalesce(get("period"), F.lit("")), F.lit("; Value="), get("value"))
    told = F.when((F.col("zone") == "data") & (get("metric") != "") & (get("value") != ""), fact).when(F.col("zone") == "knowledge", F.col("label"))
    texts = known.select("start", "node", told.alias("text")).where("text is not null")
    return Expansion(known, walked, reached.where(F.col("depth") == depth).select("start", "path"), texts)


def provenance(starts: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """The provenance chain of each start (``node``): ``start``, ``node``, ``depth``, ``path`` and the node's columns, by the edges of that zone alone."""
    rows = starts.select(F.col("node").alias("start"), "node", F.array(F.lit("provenance")).alias("zones"))
    return expand(rows, nodes, edges, depth).nodes


def induced(nodes: DataFrame, edges: DataFrame, zone: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of a zone, and the edges both of whose ends are among them, whatever the edges' own zone."""
    kept = nodes.where(F.col("zone") == zone)
    ends = kept.select("node").distinct()
    return kept, edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")


def paths(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """``start``, ``node``, ``path`` of ``depth`` edges (text, nodes joined by ``>``), each walk once."""
    rows = starts.select(F.col("node").alias("start"), "node", F.col("node").alias("path"))
    for _ in range(depth):
        rows = rows.join(edges.select(F.col("src").alias("node"), "dst").distinct(), "node").select("start", F.col("dst").alias("node"), F.concat_ws(">", "path", "dst").alias("path"))
    return rows


def incident(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node``, ``other``, ``edge_type`` in both directions; a loop counts twice."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "edge_type")
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "edge_type")
    return out.unionByName(back).join(nodes.select("node"), "node", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def connected_components(edges: DataFrame, left: str = "src", right: str = "dst", rounds: int = 60) -> DataFrame:
    """``node``, ``component``: the least node that each node with an edge reaches, directions aside.

    Rounds of star contraction: larger neighbours, then smaller ones, are pointed at the least node of
    the neighbourhood. Grouped minima and joins with one row a key on one side; a hub splits like any
    skewed join. Each round is a table in the shared folder.
    """

    def mark(df: DataFrame) -> tuple[int, int]:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo") % F.lit(1 << 40)).alias("h")).first()
        return row["n"], row["h"] or 0

    now = settle(edges.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo")).where("hi != lo").distinct(), "edges")
    last = mark(now)
    for _ in range(rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = settle(small.unionByName(lowest.withColumnRenamed("m", "lo")).distinct(), "edges")
        if (seen := mark(now)) == last:
            break
        last = seen
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """``node``, ``label`` after ``rounds`` steps: the commonest label among neighbours, the least on ties.

    It ends earlier where labels stay, or swing between two states; then the state that the last round
    would have is returned.
    """
    both = settle(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v"))).where("u != v"), "both")
    labels, before = both.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct(), None
    for step in range(1, rounds + 1):
        votes = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("u").agg(F.max("n").alias("n"))
        now = settle(votes.join(best, ["u", "n"]).groupBy("u").agg(F.min("label").alias("label")).withColumnRenamed("u", "node"), "labels")
        same = lambda other: now.join(other.withColumnRenamed("label", "was"), "node").where("label != was").isEmpty()  # noqa: E731, B023
        if step < rounds and same(labels):
            return now
        if step < rounds and before is not None and same(before):
            return now if (rounds - step) % 2 == 0 else labels
        before, labels = labels, now
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the sum over communities of L_c / m - (d_c / 2m)^2, of undirected edges."""
    a, b = labels.toDF("src", "la"), labels.toDF("dst", "lb")
    inside = edges.join(a, "src").join(b, "dst").where("la = lb").groupBy(F.col("la").alias("label")).agg(F.count("*").alias("inside"))
    degree = degrees(edges).join(labels, "node").groupBy("label").agg(F.sum("degree").alias("d"))
    m = edges.agg(F.count("*").cast("double").alias("m"))
    parts = degree.join(inside, "label", "left").crossJoin(F.broadcast(m))  # one row
    return parts.agg(F.round(F.sum(F.coalesce("inside", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)), 6).alias("modularity"))


def community_summary(nodes: DataFrame, edges: DataFrame, labels: DataFrame, top: int = 5) -> DataFrame:
    """``label``, ``size``, ``edges_inside``, ``key_nodes``: the ``top`` nodes by degree within the community."""
    a, b = labels.toDF("src", "la"), labels.toDF("dst", "lb")
    inside = edges.join(a, "src").join(b, "dst").where("la = lb")
    count = inside.groupBy(F.col("la").alias("label")).agg(F.count("*").alias("edges_inside"))
    size = labels.groupBy("label").agg(F.count("*").alias("size"))
    degree = degrees(inside).join(labels, "node")
    best = top_k(degree, ["label"], [F.desc("degree"), F.asc("node")], top).groupBy("label").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"]), ",").alias("key_nodes"))
    return size.join(count, "label", "left").join(best, "label", "left").select("label", "size", F.coalesce("edges_inside", F.lit(0)).alias("edges_inside"), "key_nodes")


def community_ids(labels: DataFrame, zone: str, first: int = 10) -> DataFrame:
    """``label``, ``community_id``, ``n_nodes`` of labels (node, label): communities are numbered from 0 by falling size, then label.

    An id is made of the ``first`` nodes by name, which are cut by rank: no community is gathered
    whole, and the numbers go by ranges, so that many small communities don't meet in one task.
    """
    sizes = labels.groupBy("label").agg(F.count("*").alias("n_nodes")).withColumn("zone", F.lit(zone))
    heads = top_k(labels.select("label", "node"), ["label"], [F.asc("node")], first).groupBy("label").agg(F.sort_array(F.collect_list("node")).alias("first"))
    rows = ranked_by_ranges(sizes, ["zone"], [F.desc("n_nodes"), F.asc("label")]).join(heads, "label")
    return rows.select("label", community_id("zone", F.col("rank") - 1, "first").alias("community_id"), "n_nodes")


def community_report(nodes: DataFrame, edges: DataFrame, labels: DataFrame, first: int = 10) -> DataFrame:
    """``label``, ``part``, ``kind``, ``n``, ``names``: for each community its node types with their ``first`` labels, and its edge types, by falling count (``rank``).

    ``part`` is node or edge; edges count inside a community. Names are cut by rank before they are gathered.
    """
    own = nodes.join(labels, nodes["node"] == labels["node"]).select(labels["label"].alias("community"), nodes["node_type"].alias("kind"), nodes["label"].alias("name"))
    counts = own.groupBy("community", "kind").agg(F.count("*").alias("n"))
    named = top_k(own.select("community", "kind", "name").distinct(), ["community", "kind"], [F.asc("name")], first)
    named = named.groupBy("community", "kind").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))
    a, b = labels.toDF("src", "la"), labels.toDF("dst", "lb")
    inside = edges.join(a, "src").join(b, "dst").where("la = lb").groupBy(F.col("la").alias("community"), F.col("edge_type").alias("kind")).agg(F.count("*").alias("n"))
    rows = counts.join(named, ["community", "kind"], "left").withColumn("part", F.lit("node")).unionByName(inside.withColumns({"names": F.lit(None).cast("string"), "part": F.lit("edge")}))
    return ranked(rows, ["community", "part"], [F.desc("n"), F.asc("kind")]).select(F.col("community").alias("label"), "part", "kind", "n", "names", "rank")


def merged_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes of both (node, label, props): the new label wins, properties are merged, the new ones on top."""
    a, b = old.alias("a"), new.alias("b")
    props = F.map_concat(F.map_filter(F.coalesce("a.props", F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(F.map_contains_key(F.coalesce("b.props", F.create_map().cast("map<string,string>")), k), F.lit(False))), F.coalesce("b.props", F.create_map().cast("map<string,string>")))
    return a.join(b, F.col("a.node") == F.col("b.node"), "full").select(F.coalesce("a.node", "b.node").alias("node"), F.coalesce("b.label", "a.label").alias("label"), props.alias("props"))
