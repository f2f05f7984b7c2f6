"""Ranking metrics over runs (query_id, item, rank) and judgments (query_id, item, rel)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fusion import running_hits

CUTOFFS = (1, 3, 5, 10, 20, 50, 100)


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with ``rel``, 0 where there is no judgment."""
    return run.join(qrels, ["query_id", "item"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def _cutoffs() -> "F.Column":
    return F.explode(F.array(*[F.lit(k).cast("long") for k in CUTOFFS])).alias("k")


def precision_recall(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``query_id``, ``k``, ``precision``, ``recall``; queries without a relevant item have recall 0."""
    relevant = qrels.where("rel > 0").groupBy("query_id").agg(F.count("*").alias("n_rel"))
    hits = judged(run, qrels).groupBy("query_id").agg(*[F.sum(((F.col("rel") > 0) & (F.col("rank") <= k)).cast("long")).alias(f"h{k}") for k in CUTOFFS])
    rows = hits.join(relevant, "query_id", "left").select("query_id", "n_rel", F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"h{k}").alias("hits")) for k in CUTOFFS])))
    return rows.select("query_id", "k", F.round(F.col("hits") / F.col("k"), 6).alias("precision"), F.round(F.coalesce(F.try_divide("hits", "n_rel"), F.lit(0.0)), 6).alias("recall"))


def ndcg(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``query_id``, ``k``, ``ndcg``: gains 2^rel - 1 over log2(rank + 1), the ideal over all judgments."""
    gain = (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("rank") + 1)
    sums = lambda df, name: df.groupBy("query_id").agg(*[F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias(f"{name}{k}") for k in CUTOFFS])
    ideal = qrels.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "item")))
    rows = sums(judged(run, qrels), "d").join(sums(ideal, "i"), "query_id", "left")
    return rows.select("query_id", F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.round(F.coalesce(F.try_divide(f"d{k}", f"i{k}"), F.lit(0.0)), 6).alias("ndcg")) for k in CUTOFFS])))


def average_precision(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``query_id``, ``ap`` (over all relevant items), ``rr`` (1 over the first relevant rank, else 0)."""
    relevant = qrels.where("rel > 0").groupBy("query_id").agg(F.count("*").alias("n_rel"))
    rows = running_hits(judged(run, qrels))
    sums = rows.groupBy("query_id").agg(F.sum(F.when(F.col("rel") > 0, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("s"), F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first"))
    out = sums.join(relevant, "query_id", "left")
    return out.select("query_id", F.round(F.coalesce(F.try_divide("s", "n_rel"), F.lit(0.0)), 6).alias("ap"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"))


def summary(results: DataFrame) -> DataFrame:
    """Of rows (method, recall, ndcg, rr, latency): count, means and the continuous 95th percentile by method."""
    return results.groupBy("method").agg(
        F.count("*").alias("n_queries"),
        *[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("recall", "ndcg", "rr", "latency")],
        F.round(F.percentile("latency", F.lit(0.95)), 6).alias("p95_latency"),
    )
