"""Fusion of ranked channels, overlap reranking and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import ranked, top_k

RRF_K, RERANK_TOP = 60, 50
#: Weights of the channels in a blend.
WEIGHTS = {"lexical": 0.4, "narrative": 0.36, "entity_schema": 0.24}


def reciprocal_ranks(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """``query_id``, ``item``, ``fused``, ``channels`` of hits (query_id, channel, item, rank)."""
    out = hits.groupBy("query_id", "item").agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 6).alias("fused"), F.count("*").alias("channels"))
    return ranked(out, ["query_id"], [F.desc("fused"), F.asc("item")])


def weighted_blend(hits: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Scores scaled to 0..1 within a query's channel (a constant channel to 0), times weights, summed.

    The range of each channel is a grouped minimum and maximum that joins back: no window sorts it.
    """
    ends = hits.groupBy("query_id", "channel").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in weights.items() for x in p]), F.col("channel")), F.lit(0.0))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    scaled = hits.join(ends, ["query_id", "channel"]).withColumn("part", weight * (F.col("score") - F.col("lo")) / span)
    out = scaled.groupBy("query_id", "item").agg(F.round(F.sum("part"), 6).alias("fused"), F.count("*").alias("channels"))
    return ranked(out, ["query_id"], [F.desc("fused"), F.asc("item")])


def source_maps(hits: DataFrame) -> DataFrame:
    """``source_ranks`` and ``source_scores`` of each (query_id, item): at most one entry for each channel."""
    pairs = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", c))))
    return hits.groupBy("query_id", "item").agg(pairs("rank").alias("source_ranks"), pairs("score").alias("source_scores"))


def fullest(hits: DataFrame, order: tuple[str, ...] = tuple(WEIGHTS)) -> DataFrame:
    """``query_id``, ``item``, ``payload``: of a hit's payloads (a map in each channel) the one with most entries.

    On ties the channel that comes first in ``order`` holds, then the channel's name; channels that
    aren't named come last. A null payload has no entry.
    """
    at = F.array_position(F.array(*map(F.lit, order)), F.col("channel"))
    place = F.when(at == 0, len(order) + 1).otherwise(at)
    size = F.coalesce(F.size("payload"), F.lit(0))  # a null map has size -1 or null, by the session's settings
    best = F.min_by("payload", F.struct(F.negative(F.greatest(size, F.lit(0))), place, F.col("channel")))
    return hits.groupBy("query_id", "item").agg(best.alias("payload"))


def overlap_rerank(candidates: DataFrame, terms: DataFrame, tokens: DataFrame, top: int = RERANK_TOP) -> DataFrame:
    """The ``top`` of each query anew, by the share of query terms that the item holds; the rest go.

    ``candidates`` (query_id, item, rank), ``terms`` (query_id, term), ``tokens`` (item, term), distinct.
    """
    kept = candidates.where(F.col("rank") <= top)
    asked = terms.groupBy("query_id").agg(F.count("*").alias("asked"))
    met = kept.join(terms, "query_id").join(tokens, ["item", "term"]).groupBy("query_id", "item").agg(F.count("*").alias("n"))
    out = kept.join(asked, "query_id", "left").join(met, ["query_id", "item"], "left").select("query_id", "item", F.col("rank").alias("old_rank"), F.round(F.coalesce(F.col("n") / F.col("asked"), F.lit(0.0)), 6).alias("rerank_score"))
    return ranked(out, ["query_id"], [F.desc("rerank_score"), F.asc("old_rank")])


def explanation(lexical: Column, semantic: Column, fused: Column, rank: Column) -> Column:
    """The parts of a score that are above 0, the final score and the rank, as text."""
    part = lambda name, c: F.when(c > 0, F.format_string(f"{name}=%.3f", F.round(c, 3)))
    parts = F.concat_ws(", ", part("BM25", lexical), part("dense", semantic), part("fused", fused))
    return F.concat_ws(" | ", F.when(parts != "", F.concat(F.lit("Scores: "), parts)), F.format_string("Final=%.4f (rank #%d)", F.round(fused, 4), rank))


def explained(rows: DataFrame, texts: DataFrame, first: int = 10, preview: int = 200) -> DataFrame:
    """The ``first`` hits of each query (query_id, item, rank, ...) with ``preview``, the first characters of the item's text.

    ``texts`` (item, text), one row an item; an item without a text has an empty preview. Only the
    texts of shown items are read past the join.
    """
    shown = rows.where(F.col("rank") <= first)
    return shown.join(texts.select("item", F.substring("text", 1, preview).alias("preview")), "item", "left").select(*rows.columns, F.coalesce("preview", F.lit("")).alias("preview"))


def final_hits(fused: DataFrame, k: int) -> DataFrame:
    return fused.where(F.col("rank") <= k)


def channel(hits: DataFrame, name: str, item: str, score: str, k: int) -> DataFrame:
    """Hits of one channel in the form that fusion takes, with their rank."""
    rows = hits.select("query_id", F.lit(name).alias("channel"), F.col(item).alias("item"), F.col(score).cast("double").alias("score"))
    return top_k(rows, ["query_id"], [F.desc("score"), F.asc("item")], k)


def running_hits(run: DataFrame) -> DataFrame:
    """Relevant items so far, in rank order."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return run.withColumn("hits", F.sum((F.col("rel") > 0).cast("long")).over(w))
