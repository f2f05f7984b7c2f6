"""Statements, ratios, facts, scores and the checks on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import grade, ratio
from .ranking import top_k

#: Weights of the nine analyses.
SCORE_WEIGHTS = (0.20, 0.15, 0.15, 0.15, 0.10, 0.10, 0.05, 0.05, 0.05)


def ratios(statements: DataFrame) -> DataFrame:
    """Margins of statements with revenue, cost and net income; null where revenue is 0."""
    return statements.withColumns({"gross_margin": F.round(ratio(F.col("revenue") - F.col("cost"), "revenue"), 6), "net_margin": F.round(ratio("net_income", "revenue"), 6)})


def latest(statements: DataFrame, by: str, year: str = "year") -> DataFrame:
    """Each group's row with the greatest year, aggregated before the shuffle."""
    rest = [c for c in statements.columns if c != by]
    return statements.groupBy(by).agg(*[F.max_by(c, year).alias(c) for c in rest]).select(*statements.columns)


def facts(statements: DataFrame, by: str, metrics: list[str], prefix: str = "fact") -> DataFrame:
    """``fact_id``, the group, ``metric``, ``period``, ``value``: a row for each metric that isn't null or 0."""
    long = statements.unpivot([by, "year"], metrics, "metric", "value").where("value is not null and value <> 0")
    return long.select(F.concat_ws(":", F.lit(prefix), F.col(by).cast("string"), "metric", F.col("year").cast("string")).alias("fact_id"), by, "metric", F.concat(F.lit("FY"), F.col("year").cast("string")).alias("period"), "value")


def wide(long: DataFrame, by: list[str], metric: str, value: str, metrics: list[str]) -> DataFrame:
    """One column for each named metric: no pass to find the names."""
    return long.groupBy(*by).pivot(metric, metrics).agg(F.first(value))


def weighted_score(parts: list[Column], weights: tuple[float, ...] = SCORE_WEIGHTS) -> Column:
    return F.round(reduce(lambda a, b: a + b, [F.lit(w) * p for w, p in zip(weights, parts, strict=False)]), 6)


def graded(df: DataFrame, score: str = "score") -> DataFrame:
    return df.withColumn("grade", grade(score))


def issues(df: DataFrame, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """``key``, ``severity``, ``rule``: a row for each (severity, rule, condition) that holds."""
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(n).alias("rule"))) for s, n, c in rules]))
    return df.select(F.col(key), F.inline(found))


#: Documents: identity and content; statements: signs and identities within their tolerances.
def document_rules(text: str = "text", source: str = "source") -> list[tuple[str, str, Column]]:
    size = F.length(F.trim(F.coalesce(F.col(text), F.lit(""))))
    return [("error", "empty_content", size == 0), ("warning", "short_content", (size > 0) & (F.length(text) < 50)), ("warning", "no_company", F.coalesce(F.col(source), F.lit("")) == "")]


def statement_rules() -> list[tuple[str, str, Column]]:
    gross = (F.col("gross_profit") != 0) & (F.col("revenue") != 0) & (F.col("cost") != 0)
    return [
        ("error", "negative_revenue", F.col("revenue") < 0),
        ("warning", "gross_profit_mismatch", gross & (F.abs(F.col("gross_profit") - (F.col("revenue") - F.col("cost"))) > 1)),
        ("warning", "net_margin_outside", F.abs(ratio("net_income", "revenue")) > 2),
    ]


def company_rules(id_col: str = "company_id", name: str = "name", identifiers: str = "identifiers") -> list[tuple[str, str, Column]]:
    """Companies: an id and a name; at least one identifier is expected."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    return [("error", "missing_id", empty(id_col)), ("error", "missing_name", empty(name)), ("warning", "no_identifiers", F.coalesce(F.size(identifiers), F.lit(0)) <= 0)]


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, and how often beyond the first."""
    return df.groupBy(key).agg((F.count("*") - 1).alias("extra")).where("extra > 0")


def weights_add_up(weights: dict[str, float] | tuple[float, ...], within: float = 0.001) -> bool:
    """Whether weights add up to 1."""
    return abs(sum(weights.values() if isinstance(weights, dict) else weights) - 1) < within


def coverage(hits: DataFrame, has: Column) -> DataFrame:
    """The share of hits that have their provenance, for each query."""
    return hits.groupBy("query_id").agg(F.round(F.avg(has.cast("double")), 6).alias("coverage"), F.count("*").alias("n"))


def balance_rules() -> list[tuple[str, str, Column]]:
    """Equity within one percent of assets less liabilities."""
    off = F.abs(F.col("equity") - (F.col("assets") - F.col("liabilities")))
    return [("warning", "balance_identity", (F.col("assets") != 0) & (off > F.abs(F.col("assets")) * 0.01))]


def best_signals(signals: DataFrame, by: str, score: str, n: int = 3) -> DataFrame:
    """The ``n`` strongest and weakest signals of each company, marked."""
    strong = top_k(signals, [by], [F.desc(score), F.asc("signal")], n).withColumn("side", F.lit("strength"))
    return strong.unionByName(top_k(signals, [by], [F.asc(score), F.asc("signal")], n).withColumn("side", F.lit("weakness")))
