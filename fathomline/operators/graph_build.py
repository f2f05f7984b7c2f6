"""Nodes and edges out of companies, statements, lexicons, documents and claims.

Nodes are (node, zone, node_type, label, props), edges (src, dst, edge_type, zone, props).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import key, short_hash

PROPS = "map<string,string>"


def props(**values: Column | str) -> Column:
    """Properties as text; those that are null are left out."""
    pairs = [F.struct(F.lit(k).alias("k"), (F.col(v) if isinstance(v, str) else v).cast("string").alias("v")) for k, v in values.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull())) if pairs else F.create_map().cast(PROPS)


def node(df: DataFrame, id_: Column, zone: str, kind: Column | str, label: Column | str, **values) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(id_.alias("node"), F.lit(zone).alias("zone"), kind.alias("node_type"), (F.col(label) if isinstance(label, str) else label).cast("string").alias("label"), props(**values).alias("props"))


def edge(df: DataFrame, src: Column, dst: Column, kind: Column | str, zone: str, **values) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(src.alias("src"), dst.alias("dst"), kind.alias("edge_type"), F.lit(zone).alias("zone"), props(**values).alias("props"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def companies(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Companies as read_companies() gives them: company, ticker, sector, industry and alias nodes with their edges."""
    me = F.col("company_id")
    tickers = df.select("company_id", F.explode("identifiers").alias("i")).where("i.id_type = 'ticker'")
    aliases = df.select("company_id", F.explode("aliases").alias("alias"))
    nodes = [node(df, me, "entity", "company", "name", sector="sector", industry="industry", country="country"), node(tickers, key(F.lit("ticker"), "i.value"), "entity", "ticker", "i.value", exchange="i.exchange")]
    edges = [edge(tickers, me, key(F.lit("ticker"), "i.value"), "listed_on", "entity")]
    for kind in ("sector", "industry"):
        had = df.where(F.coalesce(F.col(kind), F.lit("")) != "")
        nodes.append(node(had.select(kind).distinct(), key(F.lit(kind), kind), "entity", kind, kind))
        edges.append(edge(had, me, key(F.lit(kind), kind), f"belongs_to_{kind}", "entity"))
    alias = key(F.lit("alias"), "alias")
    nodes.append(node(aliases.select("alias").distinct(), alias, "lexical", "alias", "alias"))
    edges.append(edge(aliases, alias, me, "alias_of", "lexical"))
    return _all(nodes), _all(edges)


def facts(df: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Rows of finance.facts(): a node for each, and an edge from what it is about."""
    unit = F.when(F.col("metric").isin("gross_margin", "debt_to_equity"), "ratio").otherwise("USD")
    nodes = node(df, F.col("fact_id"), "data", "financial_fact", F.concat_ws(" ", "metric", "period"), metric="metric", value="value", period="period", unit=unit)
    return nodes, edge(df, F.col(by).cast("string"), F.col("fact_id"), "has_fact", "data")


def lexicon(entries: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries as nodes with an edge to what they stand for; schema mappings as nodes with an edge to their concept."""
    one = key(F.lit("lex"), "entry_id")
    two = key(F.lit("schema"), "concept", "surface_form")
    nodes = _all([node(entries, one, "lexical", F.col("entry_type"), "surface_form", canonical_id="canonical_id", confidence="confidence"), node(mappings, two, "lexical", "schema_mapping", "surface_form", concept="concept", taxonomy="taxonomy")])
    return nodes, _all([edge(entries, one, F.col("canonical_id"), "alias_of", "lexical"), edge(mappings, two, F.col("concept"), "maps_to_concept", "lexical")])


def provenance(docs: DataFrame, chunks: DataFrame, run: str = "run", agent: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, title, run) and chunks (chunk_id, doc_id, start, end): where each text comes from.

    ``agent``: the column that names who a document is attributed to; rows without one have no such edge.
    """
    doc = F.col("doc_id").cast("string")
    runs = docs.where(F.col(run).isNotNull())
    nodes = _all([node(docs, doc, "provenance", "document", "title"), node(runs.select(run).distinct(), F.col(run), "provenance", "extraction_run", F.concat(F.lit("ingestion:"), F.col(run)))])
    edges = [edge(runs, doc, F.col(run), "wasGeneratedBy", "provenance"), edge(chunks, F.col("chunk_id"), doc, "derived_from", "provenance", span_start="start", span_end="end")]
    if agent is not None:
        owned, me = docs.where(F.coalesce(F.col(agent), F.lit("")) != ""), key(F.lit("agent"), agent)
        nodes = nodes.unionByName(node(owned.select(agent).distinct(), me, "provenance", "agent", agent))
        edges.append(edge(owned, doc, me, "wasAttributedTo", "provenance"))
    return nodes, _all(edges)


def triples(edges: DataFrame) -> DataFrame:
    """``subject``, ``predicate``, ``object`` of provenance edges, with derivation by its standard name."""
    named = F.when(F.col("edge_type") == "derived_from", "wasDerivedFrom").otherwise(F.col("edge_type"))
    return edges.where("zone = 'provenance'").select(F.col("src").alias("subject"), named.alias("predicate"), F.col("dst").alias("object"))


def claims(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims (text, entities, doc_id): a node named by its text's hash, edges from what it mentions and to its source."""
    me = F.concat(F.lit("claim:"), short_hash("text"))
    about = df.select("text", F.explode("entities").alias("e"))
    edges = [edge(about, F.col("e"), me, "mentioned_in_claim", "knowledge"), edge(df.where("doc_id is not null"), me, F.col("doc_id").cast("string"), "derived_from", "provenance")]
    return node(df, me, "knowledge", "claim", "text"), _all(edges)


def find_nodes(nodes: DataFrame, *, zone: str | None = None, node_type: str | None = None, **wanted: str | None) -> DataFrame:
    """Nodes of a zone, type and properties; a property that a node lacks equals None."""
    out = nodes
    for c, v in (("zone", zone), ("node_type", node_type)):
        out = out.where(F.col(c) == v) if v else out
    for k, v in wanted.items():
        out = out.where(F.col("props")[k].eqNullSafe(F.lit(v).cast("string")))
    return out


def expansion(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """What a traversal reached, with its zone and a text for retrieval: facts as metric, period and value, claims as they are."""
    rows = reached.join(nodes, "node")
    fact = F.concat(F.lit("Metric="), F.col("props")["metric"], F.lit("; Period="), F.coalesce(F.col("props")["period"], F.lit("")), F.lit("; Value="), F.col("props")["value"])
    return rows.withColumn("text", F.when(F.col("zone") == "data", fact).when(F.col("zone") == "knowledge", F.col("label")))
