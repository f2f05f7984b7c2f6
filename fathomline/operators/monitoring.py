"""Latency percentiles, quality snapshots, drift and version registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import top_k

WINDOW = 1000


def last_n(log: DataFrame, by: list[str], order: list, n: int = WINDOW) -> DataFrame:
    """The last ``n`` rows of each group: a sliding buffer, as a top-k that is pruned before the shuffle."""
    return top_k(log, by, order, n, "_age").drop("_age")


def nearest_rank(log: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, p50, p95, p99 and maximum: the values at n // 2 and, from 21 and 101 values on, at
    floor(0.95 n) and floor(0.99 n), counted from 0; else the largest.

    Sketches bound where each of these values lies; the values below the bounds are only counted, and
    the few between them are counted by value and put in order. So no group is sorted as a whole.
    """
    rows = log.where(F.col(value).isNotNull()).select(F.col(by), F.col(value).alias("_v"))
    shares, near = {"p50": 0.5, "p95": 0.95, "p99": 0.99}, 0.002  # the sketch errs by 0.0001
    bounds = F.percentile_approx("_v", F.array(*[F.lit(x) for p in shares.values() for x in (p - near, min(1.0, p + near))]), F.lit(10_000))
    whole = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.max("_v").alias("max"), bounds.alias("_b"))
    spans = F.array(*[F.struct(F.lit(k).alias("_k"), F.floor(F.col("n") * p).alias("_at"), F.col("_b")[2 * i].alias("_lo"), F.col("_b")[2 * i + 1].alias("_hi")) for i, (k, p) in enumerate(shares.items())])
    placed = rows.join(whole.select(by, F.inline(spans)), by).where("_v <= _hi")
    counts = placed.groupBy(by, "_k", "_at", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(by, "_k").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = counts.withColumn("_upto", upto).where("_upto > _at and _v is not null").groupBy(by).agg(*[F.min(F.when(F.col("_k") == k, F.col("_v"))).alias(k) for k in shares])
    out = whole.join(found, by)
    return out.select(by, F.col("n").alias("count"), F.round("mean", 6).alias("mean"), "p50", F.when(F.col("n") > 20, F.col("p95")).otherwise(F.col("max")).alias("p95"), F.when(F.col("n") > 100, F.col("p99")).otherwise(F.col("max")).alias("p99"), "max")


def drift(current: Column, baseline: Column) -> Column:
    """|current - baseline| / |baseline|; |current| for a baseline of 0; 0 without a baseline."""
    base = F.coalesce(baseline, current)
    return F.when(base == 0, F.abs(current)).otherwise(F.abs(current - base) / F.abs(base))


def centroid_drift(vectors: DataFrame, group: Column, vector_col: str = "embedding") -> DataFrame:
    """1 - cosine of the mean vectors of two groups (``group`` true, then false): one row."""
    means = vectors.select(group.alias("g"), F.posexplode(vector_col).alias("dim", "x")).groupBy("dim").agg(F.avg(F.when(F.col("g"), F.col("x").cast("double"))).alias("a"), F.avg(F.when(~F.col("g"), F.col("x").cast("double"))).alias("b"))
    sums = means.agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    return sums.select(F.round(1 - F.coalesce(F.try_divide(F.col("ab"), F.sqrt("aa") * F.sqrt("bb")), F.lit(0.0)), 6).alias("drift"))


def sample_drift(samples: DataFrame, order: str, vector_col: str = "embedding", *, last: int = 100, least: int = 10, threshold: float = 0.05) -> DataFrame:
    """``drift`` and ``significant`` between the first and the second half of the ``last`` samples, by ``order``; nulls from under ``least`` samples."""
    rows = samples.orderBy(F.desc(order)).limit(last).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0)))).withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1)  # at most ``last`` rows
    found = centroid_drift(rows.where(F.col("_n") >= least), F.col("_i") < F.floor(F.col("_n") / 2), vector_col)
    enough = rows.agg((F.count("*") >= least).alias("_enough"))
    return found.crossJoin(F.broadcast(enough)).select(F.when(F.col("_enough"), F.col("drift")).alias("drift"), F.when(F.col("_enough"), F.col("drift") > threshold).alias("significant"))  # one row each


def quality_snapshot(log: DataFrame, by: list[str], tiers: tuple[str, ...], intents: tuple[str, ...]) -> DataFrame:
    """Of rows (top1, top10, empty, tier, intent): means of the scores, share of empty results, and how many queries of each tier and intent."""
    of = lambda column, names: [F.sum((F.col(column) == n).cast("long")).alias(f"{column}_{n}") for n in names]
    means = [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(a) for c, a in ((F.col("top1"), "avg_top1_score"), (F.col("top10"), "avg_top10_score"), (F.col("empty").cast("double"), "empty_result_rate"))]
    return log.groupBy(*by).agg(*means, *of("tier", tiers), *of("intent", intents))


def activate(generations: DataFrame, key: str, chosen: Column) -> DataFrame:
    """The ``chosen`` generation is active, all others deprecated."""
    return generations.withColumn("status", F.when(F.col(key).eqNullSafe(chosen), "active").otherwise("deprecated"))
