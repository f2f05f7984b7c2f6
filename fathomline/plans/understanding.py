"""What a question asks for: intent, tier and the stages to run, as columns over many questions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Cues of each intent; the intent with the greatest share of its cues wins, the first on ties.
INTENTS = {
    "compare": (r"\bcompare\b", r"\bvs\.?\b", r"\bversus\b", r"\bagainst\b", r"\bbetter\b", r"\bworse\b", r"\boutperform\b", r"\bunderperform\b", r"\bbenchmark\b", r"\brelative\s+to\b"),
    "explain": (r"\bwhy\b", r"\bexplain\b", r"\breason\b", r"\bcause\b", r"\bdriver\b", r"\bdue\s+to\b", r"\bbecause\b", r"\battribut\b", r"\bcontribut\b", r"\bimpact\b"),
    "compute": (r"\bcalculate\b", r"\bcompute\b", r"\bwhat\s+is\s+the\b.*\b(?:ratio|rate|cagr|growth|margin)\b", r"\baverage\b", r"\bmedian\b", r"\bsum\b", r"\btotal\b"),
    "summarize": (r"\bsummar\w+\b", r"\boverview\b", r"\bhighlight\b", r"\bkey\s+(?:point|takeaway|finding)\b", r"\btldr\b"),
    "trend": (r"\btrend\b", r"\bover\s+time\b", r"\bhistorical\b", r"\btrajectory\b", r"\bchange\b.*\b(?:over|since|from)\b", r"\bimproving\b", r"\bdeteriorating\b", r"\byoy\b", r"\bqoq\b"),
    "screen": (r"\bwhich\s+compan\w+\b", r"\bscreen\b", r"\bfilter\b", r"\bfind\s+(?:all|companies|stocks)\b", r"\blist\b.*\bcompan\w+\b", r"\b(?:greater|more|less|above|below)\s+than\b"),
}
#: The tier of each intent.
TIERS = {"find_evidence": "A", "compare": "B", "explain": "C", "compute": "A", "summarize": "B", "trend": "B", "screen": "B"}


def _cue(lower: Column, cue: str) -> Column:
    """Whether a cue is there; where it begins with a whole word, that is looked for first, which most texts don't hold."""
    word = re.match(r"\\b([a-z]{2,})", cue)
    return lower.contains(word[1]) & lower.rlike(cue) if word else lower.rlike(cue)


def _share(lower: Column, cues: tuple[str, ...]) -> Column:
    hits = [_cue(lower, p).cast("int") for p in cues]
    return sum(hits[1:], hits[0]) / F.lit(len(cues))


def parsed(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``normalized``, ``tokens``, ``entities``, ``metrics``, ``comparison``, ``negated``, ``periods``."""
    out = queries.withColumn("normalized", T.normalize_text(text_col))
    out = out.withColumn("tokens", F.regexp_extract_all("normalized", F.lit(T.WORD), F.lit(0)))
    return out.withColumns({
        "entities": F.filter("tokens", lambda t: t.rlike("^[A-Z]{1,5}$")),
        "metrics": F.filter("tokens", lambda t: F.lower(t).isin(T.METRIC_WORDS)),
        "comparison": T.comparison("normalized"),
        "negated": T.has_negation("normalized"),
        "periods": T.periods("normalized"),
    })


def routed(queries: DataFrame) -> DataFrame:
    """Adds ``shares`` (of each intent's cues), ``intent``, ``confidence``, ``tier``, ``multi``, ``needs_graph`` to parsed queries."""
    lower = queries.withColumn("_lower", F.lower("normalized"))
    out = lower.withColumn("shares", F.array(*[_share(F.col("_lower"), cues) for cues in INTENTS.values()])).drop("_lower")
    out = out.withColumn("_top", F.array_max("shares"))
    names = F.array(*[F.lit(n) for n in INTENTS])
    intent = F.when(F.col("_top") == 0, "find_evidence").otherwise(F.element_at(names, F.array_position("shares", F.col("_top")).cast("int")))
    out = out.withColumns({"intent": intent, "confidence": F.when(F.col("_top") == 0, 0.5).otherwise(F.round(F.least(F.col("_top") * 2, F.lit(1.0)), 6))}).drop("_top")
    multi = (F.size("entities") > 1) | F.coalesce(F.col("comparison") == "compare", F.lit(False))
    base = F.element_at(F.create_map(*[F.lit(x) for p in TIERS.items() for x in p]), F.col("intent"))
    out = out.withColumns({"multi": multi, "tier": F.when(multi & (base == "A"), "B").otherwise(base)})
    return out.withColumn("needs_graph", F.col("intent").isin("explain", "trend") | (F.col("tier") == "C"))


def stages(queries: DataFrame, top_k: int = 100, rerank: int = 50) -> DataFrame:
    """Adds how many items each stage takes, 0 for a stage that is off, and the zones of the graph stage."""
    wide, compute = F.col("intent") == "screen", F.col("intent") == "compute"
    graph = F.col("needs_graph") | compute
    return queries.withColumns({
        "lexical_k": F.when(wide, 200).otherwise(top_k).cast("long"),
        "semantic_k": F.when(wide, 200).when(compute, 50).otherwise(top_k).cast("long"),
        "fusion_k": F.when(wide, 200).otherwise(top_k).cast("long"),
        "rerank_k": F.when(F.col("tier").isin("B", "C"), rerank).otherwise(0).cast("long"),
        "graph_k": F.when(graph, 50).otherwise(0).cast("long"),
        "graph_zones": F.when(compute, "data").when(F.col("needs_graph"), "entity,data,knowledge").otherwise(""),
    })


def reasoning(queries: DataFrame) -> Column:
    """The decision in words, with the three strongest signals, in the order of the intents on ties."""
    signals = F.transform(F.arrays_zip(F.col("shares"), F.array(*[F.lit(n) for n in INTENTS]).alias("n")), lambda x, i: F.struct((-x["shares"]).alias("s"), i.alias("i"), x["n"].alias("n")))
    best = F.slice(F.array_sort(F.filter(signals, lambda x: x["s"] < 0)), 1, 3)
    told = F.array_join(F.transform(best, lambda x: F.format_string("%s=%.2f", x["n"], F.round(-x["s"], 6))), ", ")
    return F.concat_ws("; ", F.format_string("Intent=%s (tier %s)", "intent", "tier"), F.when(told != "", F.concat(F.lit("signals: ["), told, F.lit("]"))), F.when(F.col("multi"), "multi-company"), F.when(F.col("needs_graph"), "graph-expansion"))
