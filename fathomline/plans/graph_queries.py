"""Queries of the property graph that the keys of the tables make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import key
from ..operators import communities, graph, ranking
from ..sources.scratch import settle
from .catalog import Tables, query


def nodes(t: Tables) -> DataFrame:
    """``node``, ``zone``, ``node_type``, ``label``."""
    of = lambda df, kind, k, label, zone: df.select(key(F.lit(kind), k).alias("node"), F.lit(zone).alias("zone"), F.lit(kind).alias("node_type"), F.col(label).cast("string").alias("label"))
    out = of(t.region, "sector", "r_regionkey", "r_name", "entity")
    for df, kind, k, label, zone in ((t.nation, "industry", "n_nationkey", "n_name", "entity"), (t.customer, "company", "c_custkey", "c_name", "entity"), (t.supplier, "subsidiary", "s_suppkey", "s_name", "entity"), (t.orders, "financial_fact", "o_orderkey", "o_orderstatus", "data"), (t.part, "product", "p_partkey", "p_name", "entity")):
        out = out.unionByName(of(df, kind, k, label, zone))
    return out


def edges(t: Tables) -> DataFrame:
    """``src``, ``dst``, ``edge_type``, ``zone``."""
    of = lambda df, a, x, b, y, kind, zone: df.select(key(F.lit(a), x).alias("src"), key(F.lit(b), y).alias("dst"), F.lit(kind).alias("edge_type"), F.lit(zone).alias("zone"))
    out = of(t.nation, "industry", "n_nationkey", "sector", "n_regionkey", "belongs_to_sector", "entity")
    out = out.unionByName(of(t.customer, "company", "c_custkey", "industry", "c_nationkey", "belongs_to_industry", "entity"))
    out = out.unionByName(of(t.supplier, "subsidiary", "s_suppkey", "industry", "s_nationkey", "belongs_to_industry", "entity"))
    out = out.unionByName(of(t.orders, "company", "o_custkey", "financial_fact", "o_orderkey", "has_fact", "data"))
    supplies = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    return out.unionByName(of(supplies, "subsidiary", "l_suppkey", "product", "l_partkey", "supplies", "knowledge"))


_NODES = """nodes as (select 'sector:' || r_regionkey as node, 'entity' as zone, 'sector' as node_type, r_name as label from region union all select 'industry:' || n_nationkey, 'entity', 'industry', n_name from nation
union all select 'company:' || c_custkey, 'entity', 'company', c_name from customer union all select 'subsidiary:' || s_suppkey, 'entity', 'subsidiary', s_name from supplier
union all select 'financial_fact:' || o_orderkey, 'data', 'financial_fact', o_orderstatus from orders union all select 'product:' || p_partkey, 'entity', 'product', p_name from part)"""
_EDGES = """edges as (select 'industry:' || n_nationkey as src, 'sector:' || n_regionkey as dst, 'belongs_to_sector' as edge_type, 'entity' as zone from nation union all select 'company:' || c_custkey, 'industry:' || c_nationkey, 'belongs_to_industry', 'entity' from customer
union all select 'subsidiary:' || s_suppkey, 'industry:' || s_nationkey, 'belongs_to_industry', 'entity' from supplier union all select 'company:' || o_custkey, 'financial_fact:' || o_orderkey, 'has_fact', 'data' from orders
union all select distinct 'subsidiary:' || l_suppkey, 'product:' || l_partkey, 'supplies', 'knowledge' from lineitem)"""


@query(f"with {_NODES} from nodes")
def graph_nodes(t: Tables) -> DataFrame:
    return nodes(t)


@query(f"with {_EDGES} from edges")
def graph_edges(t: Tables) -> DataFrame:
    return edges(t)


@query(f"with {_NODES}, {_EDGES} select 'node' as item, zone, node_type as kind, count(*) as n from nodes group by all union all select 'edge', zone, edge_type, count(*) from edges group by all")
def graph_zone_stats(t: Tables) -> DataFrame:
    a = nodes(t).groupBy("zone", F.col("node_type").alias("kind")).agg(F.count("*").alias("n")).withColumn("item", F.lit("node"))
    return a.unionByName(edges(t).groupBy("zone", F.col("edge_type").alias("kind")).agg(F.count("*").alias("n")).withColumn("item", F.lit("edge")))


@query(f"with {_EDGES} select zone, edge_type, count(*) as n from edges where edge_type = 'supplies' group by all")
def graph_unknown_types(t: Tables) -> DataFrame:
    return graph.unknown_types(edges(t))


def _starts(t: Tables) -> DataFrame:
    return t.customer.where("c_custkey % 100 = 0").select(key(F.lit("company"), "c_custkey").alias("node"))


_STARTS = "starts as (select 'company:' || c_custkey as node from customer where c_custkey % 100 = 0)"


@query(f"""with recursive {_EDGES}, {_STARTS}, walk as (select node as start, node, 0::bigint as depth from starts union select start, dst, depth + 1 from walk join edges on src = node where depth < 2)
select start, node, min(depth) as depth from walk group by start, node""")
def graph_bfs2(t: Tables) -> DataFrame:
    return graph.traverse(_starts(t), edges(t), 2)


@query(f"""with recursive {_EDGES}, {_STARTS}, walk as (select node as start, node, 0::bigint as depth from starts union select start, dst, depth + 1 from walk join edges on src = node where depth < 3 and zone = 'entity')
select start, node, min(depth) as depth from walk group by start, node""")
def graph_zone_bfs(t: Tables) -> DataFrame:
    return graph.traverse(_starts(t), edges(t), 3, zones=["entity"])


@query(f"with {_EDGES}, {_STARTS} select s.node as start, b.dst as node, s.node || '>' || a.dst || '>' || b.dst as path from starts s join edges a on a.src = s.node join edges b on b.src = a.dst")
def graph_paths(t: Tables) -> DataFrame:
    return graph.paths(_starts(t), edges(t), 2)


@query(f"""with {_NODES}, {_EDGES}, {_STARTS}, i as (select src as node, dst as other, edge_type from edges union all select dst, src, edge_type from edges), j as (select i.node as node, other, edge_type from i join starts on starts.node = i.node where edge_type in ('belongs_to_industry', 'belongs_to_sector'))
select j.node, other, label, min(edge_type) as relationship from j join nodes on nodes.node = other group by all""")
def related_entities(t: Tables) -> DataFrame:
    near = graph.incident(_starts(t), edges(t)).where(F.col("edge_type").isin("belongs_to_industry", "belongs_to_sector"))
    one = near.groupBy("node", "other").agg(F.min("edge_type").alias("relationship"))
    return one.join(nodes(t).select(F.col("node").alias("other"), "label"), "other").select("node", "other", "label", "relationship")


@query("select o_custkey, year(o_orderdate) as year, 'FY' || year(o_orderdate) as period, round(sum(o_totalprice), 2) as value, row_number() over (partition by o_custkey order by 'FY' || year(o_orderdate)) as place, 'Metric=orders; Period=FY' || year(o_orderdate) || '; Count=' || count(*) as text from orders group by o_custkey, year(o_orderdate)")
def fact_timeline(t: Tables) -> DataFrame:
    rows = t.orders.groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"), F.count("*").alias("n"))
    rows = rows.withColumns({"period": F.concat(F.lit("FY"), F.col("year").cast("string")), "text": F.concat(F.lit("Metric=orders; Period=FY"), F.col("year").cast("string"), F.lit("; Count="), F.col("n").cast("string"))}).drop("n")
    return ranking.ranked(rows, ["o_custkey"], ["period"], "place")


@query("select 'doc:' || doc_id as src, 'run:' || source as dst, 'wasGeneratedBy' as edge_type, n_chars as span_end from documents union all select 'text:' || sha256(text), 'doc:' || min(doc_id), 'derived_from', max(n_chars) from documents group by text")
def provenance_edges(t: Tables) -> DataFrame:
    made = t.documents.select(key(F.lit("doc"), "doc_id").alias("src"), key(F.lit("run"), "source").alias("dst"), F.lit("wasGeneratedBy").alias("edge_type"), F.col("n_chars").alias("span_end"))
    texts = t.documents.select("doc_id", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("h")).groupBy("h").agg(F.min("doc_id").alias("d"), F.max("n_chars").alias("n"))
    return made.unionByName(texts.select(key(F.lit("text"), "h").alias("src"), key(F.lit("doc"), "d").alias("dst"), F.lit("derived_from").alias("edge_type"), F.col("n").alias("span_end")))


_PATHS = "array_to_string(min(path), '>')"
_FACTS = "facts as (select 'financial_fact:' || o_orderkey as node, 'Metric=' || o_orderpriority || '; Period=FY' || year(o_orderdate) || '; Value=' || o_custkey as text from orders)"


def _expansion(t: Tables, depth: int) -> graph.Expansion:
    """Of some companies, within two zones; facts have properties."""
    facts = t.orders.select(key(F.lit("financial_fact"), "o_orderkey").alias("node"), F.create_map(F.lit("metric"), F.col("o_orderpriority"), F.lit("period"), F.concat(F.lit("FY"), F.year("o_orderdate").cast("string")), F.lit("value"), F.col("o_custkey").cast("string")).alias("props"))
    starts = _starts(t).select(F.col("node").alias("start"), "node", F.array(F.lit("entity"), F.lit("data")).alias("zones"))
    return graph.expand(starts, nodes(t).join(facts, "node", "left"), edges(t), depth)


@query(f"""with recursive {_NODES}, {_EDGES}, {_STARTS}, {_FACTS}, walk as (select node as start, node, 0::bigint as depth, [node] as path from starts union select start, dst, depth + 1, list_append(path, dst) from walk join edges on src = node where depth < 2 and zone in ('entity', 'data')),
best as (select start, node, depth, {_PATHS} as path from walk group by all having depth = (select min(depth) from walk w where w.start = walk.start and w.node = walk.node))
select best.start, best.node, depth, path, zone, node_type, label, text from best join nodes on nodes.node = best.node left join facts on facts.node = best.node""".replace("group by all having depth = (select min(depth) from walk w where w.start = walk.start and w.node = walk.node)", "group by start, node, depth qualify depth = min(depth) over (partition by start, node)"))
def graph_expand(t: Tables) -> DataFrame:
    """Nodes by zone with the least shortest path, and the texts of facts."""
    found = _expansion(t, 2)
    rows = found.nodes.drop("props").withColumn("path", F.array_join("path", ">"))
    return rows.join(found.texts, ["start", "node"], "left")


@query(f"""with recursive {_EDGES}, {_STARTS}, walk as (select node as start, node, 0::bigint as depth from starts union select start, dst, depth + 1 from walk join edges on src = node where depth < 2 and zone in ('entity', 'data')),
best as (select start, node, min(depth) as depth from walk group by start, node) select start, depth, src, dst, edge_type, zone from best join edges on src = node where depth < 2 and zone in ('entity', 'data')""")
def graph_expand_edges(t: Tables) -> DataFrame:
    """The edges of every node that the walk goes on from."""
    return _expansion(t, 2).edges


_PROVENANCE = """pn as (select distinct 'doc:' || doc_id as node, 'document' as node_type, lang as label from documents union select 'text:' || sha256(text), 'document', 'text' from documents union select 'run:' || source, 'extraction_run', source from documents union select 'agent:' || lang, 'system', lang from documents),
pe as (select 'text:' || sha256(text) as src, 'doc:' || min(doc_id) as dst from documents group by text union all select 'doc:' || doc_id, 'run:' || source from documents union all select 'doc:' || doc_id, 'agent:' || lang from documents union all select distinct 'run:' || source, 'agent:' || lang from documents)"""


def _provenance(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Texts derived from their first document, documents generated by runs and attributed to agents, with which runs are associated."""
    d = t.documents.select(key(F.lit("doc"), "doc_id").alias("doc"), "doc_id", F.concat(F.lit("text:"), F.sha2(F.col("text").cast("binary"), 256)).alias("text"), key(F.lit("run"), "source").alias("run"), key(F.lit("agent"), "lang").alias("agent"), "source", "lang")
    node = lambda c, kind, label: d.select(F.col(c).alias("node"), F.lit("provenance").alias("zone"), F.lit(kind).alias("node_type"), label.alias("label"), F.create_map().cast("map<string,string>").alias("props"))
    parts = [node("doc", "document", F.col("lang")), node("text", "document", F.lit("text")), node("run", "extraction_run", F.col("source")), node("agent", "system", F.col("lang"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).dropDuplicates(["node"])
    edge = lambda df, a, b, kind: df.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("edge_type"), F.lit("provenance").alias("zone"))
    first = d.groupBy("text").agg(key(F.lit("doc"), F.min("doc_id")).alias("doc"))
    out = edge(first, "text", "doc", "derived_from").unionByName(edge(d, "doc", "run", "wasGeneratedBy")).unionByName(edge(d, "doc", "agent", "wasAttributedTo"))
    return every, out.unionByName(edge(d.select("run", "agent").distinct(), "run", "agent", "wasAssociatedWith"))


@query(f"""with recursive {_PROVENANCE}, s as (select distinct 'text:' || sha256(text) as node from documents), walk as (select node as start, node, 0::bigint as depth, [node] as path from s union select start, dst, depth + 1, list_append(path, dst) from walk join pe on src = node where depth < 3)
select w.start, w.node, depth, {_PATHS} as path, node_type, label from walk w join pn on pn.node = w.node group by w.start, w.node, depth, node_type, label qualify depth = min(depth) over (partition by w.start, w.node)""")
def provenance_walk(t: Tables) -> DataFrame:
    """Every text's chain of documents, runs and agents, three steps deep."""
    every, out = _provenance(t)
    found = graph.provenance(every.where("node like 'text:%'"), every, out)
    return found.select("start", "node", "depth", F.array_join("path", ">").alias("path"), "node_type", "label")


@query(f"with {_NODES}, {_EDGES}, d as (from nodes where zone = 'entity') select src, dst, edge_type, zone from edges where src in (select node from d) and dst in (select node from d)")
def zone_subgraph(t: Tables) -> DataFrame:
    """The edges that the entity zone's nodes induce, of other zones too."""
    return graph.induced(nodes(t), edges(t), "entity")[1]


_REGION = "lab as (select 'industry:' || n_nationkey as node, n_regionkey as label from nation union all select 'company:' || c_custkey, n_regionkey from customer join nation on n_nationkey = c_nationkey union all select 'sector:' || r_regionkey, r_regionkey from region)"


@query(f"""with {_NODES}, {_EDGES}, {_REGION}, o as (select lab.label as c, node_type as kind, nodes.label as name from nodes join lab using (node)), x as (select c, kind, count(*) as n from o group by all), nm as (select distinct c, kind, name from o), nr as (from nm qualify row_number() over (partition by c, kind order by name) <= 10),
g as (select c, kind, string_agg(name, ',' order by name) as names from nr group by all), i as (select a.label as c, edge_type as kind, count(*) as n from edges join lab a on a.node = src join lab b on b.node = dst where a.label = b.label group by all),
r as (select c as label, 'node' as part, kind, n, names from x left join g using (c, kind) union all select c, 'edge', kind, n, null from i) select *, row_number() over (partition by label, part order by n desc, kind) as rank from r""")
def community_report(t: Tables) -> DataFrame:
    """Regions as communities: labels by type, edge types by count."""
    nation = t.nation.select("n_nationkey", "n_regionkey")
    labels = nation.select(key(F.lit("industry"), "n_nationkey").alias("node"), F.col("n_regionkey").alias("label"))
    labels = labels.unionByName(t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(key(F.lit("company"), "c_custkey").alias("node"), F.col("n_regionkey").alias("label")))
    labels = labels.unionByName(t.region.select(key(F.lit("sector"), "r_regionkey").alias("node"), F.col("r_regionkey").alias("label")))
    return graph.community_report(nodes(t), edges(t), labels)


@query("""with p as (select 'doc:' || doc_id as doc, 'text:' || sha256(text) as txt, source from documents), m as (select txt, min(cast(substr(doc, 5) as bigint)) as d from p group by txt)
select 'text:' || substr(m.txt, 6) as start, 'doc:' || m.d as doc, 'run:' || source as run from m join p on p.doc = 'doc:' || m.d where m.d % 100 = 0""")
def provenance_chain(t: Tables) -> DataFrame:
    """From a text to its first document and the run that made it."""
    e = settle(provenance_edges(t), "provenance").select("src", "dst", "edge_type")
    first = e.where("edge_type = 'derived_from'").where(F.substring_index("dst", ":", -1).cast("long") % 100 == 0)
    return first.join(e.where("edge_type = 'wasGeneratedBy'").select(F.col("src").alias("dst"), F.col("dst").alias("run")), "dst").select(F.col("src").alias("start"), F.col("dst").alias("doc"), "run")


@query(f"with {_EDGES}, d as (select node, count(*) as degree from (select src as node from edges union all select dst from edges) group by node) select split_part(node, ':', 1) as kind, node, degree, row_number() over (partition by split_part(node, ':', 1) order by degree desc, node) as rank from d qualify row_number() over (partition by split_part(node, ':', 1) order by degree desc, node) <= 5")
def top_degree(t: Tables) -> DataFrame:
    rows = graph.degrees(edges(t)).withColumn("kind", F.substring_index("node", ":", 1))
    return ranking.top_k(rows, ["kind"], [F.desc("degree"), F.asc("node")], 5)


#: Few distinct edges by which parts hang together: a brand of a size, a type of a size.
_PARTS = "pe as (select distinct 'brand:' || p_brand || p_size % 10 as src, 'type:' || p_type || p_size % 10 as dst from part)"


def _part_edges(t: Tables) -> DataFrame:
    size = (F.col("p_size") % 10).cast("string")
    return t.part.select(F.concat(F.lit("brand:"), "p_brand", size).alias("src"), F.concat(F.lit("type:"), "p_type", size).alias("dst")).distinct()


@query(f"""with recursive {_PARTS}, pairs as (select src as u, dst as v from pe union select dst, src from pe), reach as (select u as node, u as other from pairs union select node, v from reach join pairs on u = other) select node, min(other) as component from reach group by node""")
def connected_components(t: Tables) -> DataFrame:
    return graph.connected_components(_part_edges(t))


def _brand_labels(t: Tables) -> DataFrame:
    size = F.col("p_size") % 10
    brands = t.part.select(F.concat(F.lit("brand:"), "p_brand", size.cast("string")).alias("node"), size.cast("long").alias("label"))
    kinds = t.part.select(F.concat(F.lit("type:"), "p_type", size.cast("string")).alias("node"), size.cast("long").alias("label"))
    return brands.unionByName(kinds).distinct()


_LABELS = f"{_PARTS}, lab as (select distinct 'brand:' || p_brand || p_size % 10 as node, (p_size % 10)::bigint as label from part union select distinct 'type:' || p_type || p_size % 10, (p_size % 10)::bigint from part)"


@query(f"""with {_LABELS}, m as (select count(*)::double as m from pe), i as (select a.label, count(*) as n from pe join lab a on a.node = src join lab b on b.node = dst where a.label = b.label group by a.label),
d as (select label, count(*) as d from (select src as node from pe union all select dst from pe) join lab using (node) group by label) select round(sum(coalesce(n, 0) / m - pow(d / (2 * m), 2)), 6) as modularity from d left join i using (label), m""")
def modularity(t: Tables) -> DataFrame:
    return graph.modularity(_part_edges(t), _brand_labels(t))


@query(f"""with {_LABELS}, e as (select src, dst, a.label from pe join lab a on a.node = src join lab b on b.node = dst where a.label = b.label), deg as (select node, label, count(*) as degree from (select src as node, label from e union all select dst, label from e) group by all),
k as (select label, string_agg(node, ',' order by degree desc, node) as key_nodes from (from deg qualify row_number() over (partition by label order by degree desc, node) <= 5) group by label)
select label, count(*) as size, (select count(*) from e where e.label = lab.label) as edges_inside, max(key_nodes) as key_nodes from lab left join k using (label) group by label""")
def community_summary(t: Tables) -> DataFrame:
    return graph.community_summary(nodes(t), _part_edges(t), _brand_labels(t))


_ROUNDS = ", ".join(f"v{k} as (select u, label, count(*) as n from both_ways join l{k - 1} on v = node group by all), l{k} as (select u as node, label from v{k} qualify row_number() over (partition by u order by n desc, label) = 1)" for k in range(1, 5))


@query(f"with {_LABELS}, both_ways as (select src as u, dst as v from pe where src <> dst union all select dst, src from pe where src <> dst), l0 as (select distinct u as node, u as label from both_ways), {_ROUNDS} from l4")
def label_propagation(t: Tables) -> DataFrame:
    """Four rounds."""
    return graph.label_propagation(_part_edges(t), 4)


@query()
def louvain_communities(t: Tables) -> DataFrame:
    """Tests hold the modularity against a plain run on small graphs."""
    return communities.louvain(_part_edges(t))


@query(f"with {_NODES} select node, zone || ':' || node_type as label, 'new' as origin from nodes where node_type = 'sector' union all select node, label, 'old' from nodes where node_type <> 'sector' and node_type in ('industry', 'company')")
def merge_nodes(t: Tables) -> DataFrame:
    """Nodes with properties, of which those of one kind come again with new labels."""
    props = lambda v: F.create_map(F.lit("origin"), F.lit(v))
    old = nodes(t).where(F.col("node_type").isin("sector", "industry", "company")).select("node", "label", props("old").alias("props"))
    new = nodes(t).where("node_type = 'sector'").select("node", key("zone", "node_type").alias("label"), props("new").alias("props"))
    return graph.merged_nodes(old, new).select("node", "label", F.element_at("props", "origin").alias("origin"))
