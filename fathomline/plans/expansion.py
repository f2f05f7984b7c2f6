"""Questions with what a lexicon knows of their words: companies and periods as filters, more terms for the search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokens import narrative_tokens
from ..operators import lexicon
from ..operators.ranking import first_wins
from ..sources.scratch import lookup, settle


def _listed(rows: DataFrame, name: str, value: Column, order: list[str]) -> DataFrame:
    """``query_id`` and an array of ``value``, in ``order``, each once."""
    made = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*order, value.alias("v")))).alias("x"))
    return made.select("query_id", F.array_distinct(F.transform("x", lambda x: x["v"])).alias(name))


def expanded(questions: DataFrame, entries: DataFrame, tickers: DataFrame, abbreviations: DataFrame, mappings: DataFrame) -> DataFrame:
    """``query_id``, ``expanded``, ``company_ids``, ``periods`` of questions (query_id, text).

    Identifiers are resolved, and those that name companies make a filter; so do periods. The terms are
    the identifiers and words in order, each identifier followed by what it abbreviates; then labels of
    concepts that words or runs of two or three words link to; then other forms of what words stand
    for. Terms that are there already aren't added. Each table is asked for its distinct words at once.
    """
    asked = questions.select("query_id", F.posexplode(narrative_tokens("text")).alias("i", "t"))
    rows = settle(asked.select("query_id", "i", "t.text", "t.kind", "t.normalized"), "question-tokens")
    named, words = rows.where("kind = 'identifier'"), rows.where("kind = 'narrative'")

    resolved = lexicon.routed(lexicon.resolve(named.select(F.col("text").alias("mention")), entries, tickers)).where("role = 'company'")
    companies = _listed(named.join(lookup(resolved, "companies"), F.trim("text") == F.col("mention")), "company_ids", F.col("canonical_id"), ["i"])
    periods = _listed(rows.where("kind = 'period'"), "periods", F.col("normalized"), ["i"])

    short = lookup(lexicon.expand_abbreviations(named.select(F.col("text").alias("token")), abbreviations), "short")
    base = rows.where("kind in ('identifier', 'narrative')").select("query_id", F.lit(0).alias("step"), "i", F.lit(0).alias("j"), F.col("text").alias("term"))
    base = base.unionByName(named.join(short, F.col("text") == F.col("token")).select("query_id", F.lit(0).alias("step"), "i", F.lit(1).alias("j"), F.col("expansion").alias("term")))

    parts = questions.select("query_id", T.words(F.lower("text")).alias("w"))
    phrases = [parts.select("query_id", F.lit(n).alias("n"), F.posexplode(T.ngrams("w", n)).alias("i", "term")) for n in (2, 3)]
    candidates = words.select("query_id", F.lit(1).alias("n"), "i", F.col("text").alias("term")).unionByName(phrases[0]).unionByName(phrases[1])
    links = lookup(lexicon.link_schema(candidates.select("term"), mappings, abbreviations).select(F.col("term").alias("linked"), "label"), "links")
    labels = candidates.join(links, F.trim("term") == F.col("linked")).select("query_id", F.lit(1).alias("step"), (F.col("n") * 1_000_000 + F.col("i")).alias("i"), F.lit(0).alias("j"), F.col("label").alias("term"))

    forms = lookup(lexicon.synonyms(words.select(F.col("text").alias("word")), entries), "forms")
    more = words.join(forms, F.col("text") == F.col("word")).select("query_id", F.lit(2).alias("step"), "i", F.lit(0).alias("j"), F.col("synonym").alias("term"))

    added = first_wins(labels.unionByName(more), ["query_id", "term"], [F.asc("step"), F.asc("i")])
    added = added.join(base.select("query_id", "term").distinct().hint("merge"), ["query_id", "term"], "left_anti")  # a row a word of all questions: never a broadcast
    terms = base.unionByName(added.select(*base.columns)).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("step", "i", "j", "term"))).alias("x"))
    terms = terms.select("query_id", F.array_join(F.transform("x", lambda x: x["term"]), " ").alias("expanded"))
    none = F.array().cast("array<string>")
    out = questions.select("query_id").join(terms.hint("merge"), "query_id", "left").join(companies.hint("merge"), "query_id", "left").join(periods.hint("merge"), "query_id", "left")
    return out.select("query_id", F.coalesce("expanded", F.lit("")).alias("expanded"), F.coalesce(F.col("company_ids").cast("array<string>"), none).alias("company_ids"), F.coalesce("periods", none).alias("periods"))
