"""Hybrid retrieval over many queries at once: channels, fusion, selective rerank, explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import fusion, graph, lexical, vector
from ..operators.ranking import top_k
from ..sources.scratch import settle
from . import understanding

#: Hits of a channel that a question's plan may ask for.
DEPTH = 200


def hybrid(lexical_hits: DataFrame, vector_hits: DataFrame, *, k: int = 20, candidates: int = 100, method: str = "rrf") -> DataFrame:
    """``query_id``, ``item``, ``fused``, ``rank``: two channels, cut at ``candidates``, fused, cut at ``k``.

    Hits are (query_id, item, score).
    """
    both = fusion.channel(lexical_hits, "lexical", "item", "score", candidates).unionByName(fusion.channel(vector_hits, "narrative", "item", "score", candidates))
    fused = fusion.reciprocal_ranks(both) if method == "rrf" else fusion.weighted_blend(both)
    return fusion.final_hits(fused, k)


def tiered(fused: DataFrame, tiers: DataFrame, terms: DataFrame, tokens: DataFrame, k: int = 20) -> DataFrame:
    """Fused candidates, reranked by overlap only for the queries of tiers B and C; ``query_id``, ``item``, ``rank``, ``tier``.

    The queries are split by tier before the expensive branch.
    """
    marked = fused.join(tiers.select("query_id", "tier"), "query_id")
    plain = marked.where("tier = 'A'").select("query_id", "item", "rank", "tier")
    better = marked.where("tier <> 'A'")
    again = fusion.overlap_rerank(better.select("query_id", "item", "rank"), terms.join(better.select("query_id").distinct(), "query_id", "left_semi"), tokens)
    again = again.join(tiers.select("query_id", "tier"), "query_id").select("query_id", "item", "rank", "tier")
    return plain.unionByName(again).where(F.col("rank") <= k)


def lexical_hits(docs: DataFrame, terms: DataFrame, **how) -> DataFrame:
    return lexical.bm25(docs, terms, **how).withColumnRenamed("doc_id", "item")


def answer(
    questions: DataFrame,
    docs: DataFrame,
    vectors: DataFrame,
    query_vectors: DataFrame,
    *,
    k: int = 20,
    expansions: DataFrame | None = None,
    owners: DataFrame | None = None,
    edges: DataFrame | None = None,
    sections: DataFrame | None = None,
    boosts: dict[str, float] = lexical.SECTION_BOOSTS,
) -> DataFrame:
    """From questions (query_id, text) to explained hits: parse, route, expand, plan, retrieve in two channels,
    fuse, rerank where the tier asks for it, widen by the graph, explain.

    ``vectors`` (item, embedding) and ``query_vectors`` (query_id, embedding) come from one embedding
    model. ``expansions`` are those of plans.expansion: their terms are searched for, and where they name
    companies, only documents of these (``owners``: item, company_id) are hits. How deep each channel
    is read, and whether hits are reranked, is each question's plan. With ``edges``, ``related`` has
    what the named companies reach in two steps within the plan's zones. With ``sections`` (item, section),
    lexical scores are multiplied by their section's boost before they are cut. Returns ``query_id``,
    ``item``, ``rank``, ``tier``, ``intent``, ``explanation``, and ``related`` with ``edges``.
    """
    plan = understanding.stages(understanding.routed(understanding.parsed(questions)))
    if expansions is not None:
        plan = plan.join(expansions.select("query_id", "expanded", "company_ids"), "query_id", "left")
    plan = settle(plan, "plan")
    searched = F.col("normalized") if expansions is None else F.coalesce(F.when(F.col("expanded") != "", F.col("expanded")), F.col("normalized"))
    terms = lexical.query_terms(plan.withColumn("searched", searched), "query_id", "searched")
    both = vectors.select(F.col("item").alias("vec_id"), "embedding")
    asked = query_vectors.select((-F.col("query_id") - 1).alias("vec_id"), "embedding")  # ids that no item has
    narrowed = owners is not None and expansions is not None
    free = asked.join(plan.where("size(company_ids) > 0").select((-F.col("query_id") - 1).alias("vec_id")), "vec_id", "left_anti") if narrowed else asked
    vec = vector.nearest(both, free, DEPTH).select((-F.col("query_id") - 1).alias("query_id"), F.col("vec_id").alias("item"), "score")
    beside = {}
    if sections is not None:
        table = F.create_map(*[F.lit(x) for pair in boosts.items() for x in pair])
        beside["factors"] = sections.select(F.col("item").alias("doc_id"), F.coalesce(F.element_at(table, F.col("section")), F.lit(1.0)).alias("factor"))
    if narrowed:
        beside |= {"owners": owners.select(F.col("item").alias("doc_id"), "company_id"), "companies": plan}
    lex = lexical.bm25_top(docs, terms, DEPTH, **beside).withColumnRenamed("doc_id", "item")
    if narrowed:
        vec = vec.unionByName(_within_companies(plan, owners, vectors, query_vectors))
    hits = fusion.channel(lex, "lexical", "item", "score", DEPTH).unionByName(fusion.channel(vec, "narrative", "item", "score", DEPTH))
    cut = F.when(F.col("channel") == "lexical", F.col("lexical_k")).otherwise(F.col("semantic_k"))
    hits = settle(hits.join(plan.select("query_id", "lexical_k", "semantic_k"), "query_id").where(F.col("rank") <= cut).drop("lexical_k", "semantic_k"), "hits")
    fused = fusion.reciprocal_ranks(hits).join(plan.select("query_id", "fusion_k"), "query_id").where("rank <= fusion_k").drop("fusion_k")
    held = lexical.item_terms(docs, fused.where(F.col("rank") <= fusion.RERANK_TOP), terms)
    final = tiered(fused, plan.select("query_id", "tier"), terms, held, k)
    by = lambda n: F.coalesce(F.max(F.when(F.col("channel") == n, F.col("score"))), F.lit(0.0))
    scores = hits.groupBy("query_id", "item").agg(by("lexical").alias("l"), by("narrative").alias("v"))
    rows = final.join(scores, ["query_id", "item"]).join(fused.select("query_id", "item", "fused"), ["query_id", "item"]).join(plan.select("query_id", "intent"), "query_id")
    rows = rows.select("query_id", "item", "rank", "tier", "intent", fusion.explanation(F.col("l"), F.col("v"), F.col("fused"), F.col("rank")).alias("explanation"))
    if edges is None or expansions is None:
        return rows
    starts = plan.where("graph_k > 0").select(F.col("query_id").alias("start"), F.explode("company_ids").alias("node"), F.split("graph_zones", ",").alias("zones"))
    near = graph.walk(starts, edges, 2).where("depth > 0")
    found = near.groupBy(F.col("start").alias("query_id")).agg(F.sort_array(F.collect_set("node")).alias("related"))  # two steps from a question's companies
    return rows.join(found, "query_id", "left").withColumn("related", F.coalesce("related", F.array().cast("array<string>")))


def _within_companies(plan: DataFrame, owners: DataFrame, vectors: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """``query_id``, ``item``, ``score``: the nearest vectors of the companies that a question names; no others are scored."""
    named = plan.select("query_id", F.explode("company_ids").alias("company_id")).distinct().join(query_vectors.select("query_id", F.col("embedding").alias("q")), "query_id")
    own = owners.select("item", "company_id").join(vectors.select("item", "embedding"), "item")
    scored = named.join(own, "company_id").select("query_id", "item", F.round(V.cosine("q", "embedding"), 6).alias("score")).distinct()
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("item")], DEPTH).drop("rank")


def related(starts: DataFrame, edges: DataFrame, depth: int = 2, zones: list[str] | None = None) -> DataFrame:
    """``start``, ``node``, ``zone``, ``depth``: what many starts reach within ``zones``, with the zone of the edge that leads there on the least path."""
    rows = starts.select("start", F.col("start").alias("node"))
    if zones is not None:
        rows = rows.withColumn("zones", F.array(*[F.lit(z) for z in zones]))
    return graph.walk(rows, edges, depth).where("depth > 0").select("start", "node", F.col("edge_zone").alias("zone"), "depth")
