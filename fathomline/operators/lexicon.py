"""Lexicon lookups: exact and fuzzy resolution, schema links, synonyms, expansion, upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle
from .lexical import trigram_pairs
from .ranking import first_wins

ENTITY_TYPES, METRIC_TYPES = ("ticker", "company_alias"), ("abbreviation", "xbrl_concept", "metric_alias")


def ticker_forms(tickers: DataFrame) -> DataFrame:
    """One row for each ticker and variant: ``form`` in upper case, ``canonical_id``, ``label``, ``seq``."""
    forms = F.explode(F.concat(F.array("ticker"), F.coalesce("variants", F.array().cast("array<string>"))))
    return tickers.select("canonical_id", F.col("company_name").alias("label"), "seq", forms.alias("form")).withColumn("form", F.upper("form"))


def resolve(mentions: DataFrame, entries: DataFrame, tickers: DataFrame | None = None, *, least: float = 0.3) -> DataFrame:
    """Each distinct ``mention`` with what it resolves to, by the first way that does.

    Ways: exact ticker (first in the list's order), exact surface form (most confident), most similar
    ticker form, most similar surface form; the last two by trigrams, at ``least``. Columns: mention,
    canonical_id, label, entry_type, method, confidence, sim. Mentions without a match are left out.
    """
    rest = mentions.select(F.trim("mention").alias("mention")).where("mention <> ''").distinct()
    out = None

    def add(found: DataFrame) -> None:
        nonlocal rest, out
        found = settle(found.select("mention", "canonical_id", "label", "entry_type", "method", F.col("confidence").cast("double"), F.col("sim").cast("double")), "resolved")
        out = found if out is None else out.unionByName(found)
        rest = rest.join(found.select("mention"), "mention", "left_anti")

    if tickers is not None:
        forms = ticker_forms(tickers)
        exact = rest.join(forms, F.upper("mention") == F.col("form"))
        add(first_wins(exact, ["mention"], [F.asc("seq")]).withColumns({"entry_type": F.lit("ticker"), "method": F.lit("exact_ticker"), "confidence": F.lit(1.0), "sim": F.lit(1.0)}))
    exact = rest.join(entries.withColumn("low", F.lower("surface_form")), F.lower("mention") == F.col("low"))
    add(first_wins(exact, ["mention"], [F.desc("confidence"), F.asc("entry_id")]).withColumns({"label": F.col("canonical_label"), "method": F.lit("exact_alias"), "sim": F.lit(1.0)}))
    rest = settle(rest, "unresolved")  # each further way would work out all before it again
    if tickers is not None:
        near = trigram_pairs(rest, ticker_forms(tickers), "mention", "form", least).join(ticker_forms(tickers), "form")
        add(first_wins(near, ["mention"], [F.desc("sim"), F.asc("seq"), F.asc("form")]).withColumns({"entry_type": F.lit("ticker"), "method": F.lit("trigram_ticker"), "confidence": F.col("sim")}))
    near = trigram_pairs(rest, entries, "mention", "surface_form", least).join(entries, "surface_form")
    add(first_wins(near, ["mention"], [F.desc("sim"), F.asc("entry_id")]).withColumns({"label": F.col("canonical_label"), "method": F.lit("trigram_alias"), "confidence": F.round(F.col("sim") * F.col("confidence"), 6)}))
    return out


def unresolved(mentions: DataFrame, resolved: DataFrame) -> DataFrame:
    return mentions.select(F.trim("mention").alias("mention")).where("mention <> ''").distinct().join(resolved.select("mention"), "mention", "left_anti")


def routed(resolved: DataFrame) -> DataFrame:
    """Resolved mentions with ``role``: company for tickers and names, metric for terms of reports, else null."""
    return resolved.withColumn("role", F.when(F.col("entry_type").isin(*ENTITY_TYPES), "company").when(F.col("entry_type").isin(*METRIC_TYPES), "metric"))


def link_schema(terms: DataFrame, mappings: DataFrame, abbreviations: DataFrame | None = None, *, least: float = 0.4) -> DataFrame:
    """Each distinct ``term`` with a concept: by abbreviation, then exactly, then by trigrams at ``least``."""
    rest = settle(terms.select(F.trim("term").alias("term")).where("term <> ''").distinct(), "terms").hint("merge")
    out = None
    if abbreviations is not None:
        hit = rest.join(abbreviations.where("metric_id <> ''").withColumn("up", F.upper(F.trim("abbreviation"))), F.upper("term") == F.col("up"))
        out = first_wins(hit, ["term"], [F.asc("seq")]).select("term", F.col("metric_id").alias("concept"), F.lit("custom").alias("taxonomy"), F.col("expansion").alias("label"), F.lit("abbreviation").alias("method"), F.lit(1.0).alias("confidence"))
        rest = rest.join(out.select("term"), "term", "left_anti")
    exact = rest.join(mappings.withColumn("low", F.lower(F.trim("surface_form"))), F.lower("term") == F.col("low"))
    exact = first_wins(exact, ["term"], [F.desc("confidence"), F.asc("concept")]).select("term", "concept", "taxonomy", "label", F.lit("exact").alias("method"), F.col("confidence").cast("double").alias("confidence"))
    out = exact if out is None else out.unionByName(exact)
    rest = rest.join(exact.select("term"), "term", "left_anti")
    near = trigram_pairs(rest, mappings, "term", "surface_form", least).join(mappings.drop("confidence"), "surface_form")
    near = first_wins(near, ["term"], [F.desc("sim"), F.asc("concept")]).select("term", "concept", "taxonomy", "label", F.lit("fuzzy").alias("method"), F.col("sim").alias("confidence"))
    return out.unionByName(near)


def synonyms(words: DataFrame, entries: DataFrame) -> DataFrame:
    """``word``, ``synonym``: the other surface forms of what a word's form stands for."""
    own = entries.select(F.lower("surface_form").alias("low"), "canonical_id")
    other = entries.select("canonical_id", F.col("surface_form").alias("synonym"))
    met = settle(words.select("word").distinct(), "words").hint("merge").join(own, F.lower("word") == F.col("low")).join(other, "canonical_id")
    return met.where(F.lower("synonym") != F.lower("word")).select("word", "synonym").distinct()


def taxonomy(concepts: DataFrame) -> DataFrame:
    """``term``, ``concept``, ``taxonomy`` of (name, label); a label with commas also with its parts reversed."""
    base = concepts.select(F.lower("label").alias("term"), F.col("name").alias("concept"), F.when(F.col("name").contains(":"), F.substring_index("name", ":", 1)).otherwise("custom").alias("taxonomy"))
    turned = base.where(F.col("term").contains(",")).withColumn("term", F.array_join(F.reverse(F.split("term", ", ")), " "))
    return base.unionByName(turned)


def upsert(old: DataFrame, new: DataFrame, key: str, replaced: list[str]) -> DataFrame:
    """``new`` rows added, and the ``replaced`` columns of known keys taken from them; other columns stay."""
    a, b = old.alias("a"), new.alias("b")
    pick = lambda c: F.coalesce(f"b.{c}", f"a.{c}") if c in replaced else F.coalesce(f"a.{c}", f"b.{c}")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*[pick(c).alias(c) for c in old.columns])


def insert_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and those rows of ``new`` whose key isn't there."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(*old.columns))


def entry_id(version: str, canonical: Column, surface: Column) -> Column:
    return F.concat_ws(":", F.lit(version), canonical, surface)


def entries_of_tickers(tickers: DataFrame, version: str = "v1") -> DataFrame:
    """Lexicon entries: the ticker at confidence 1, its variants at 0.95."""
    forms = F.explode(F.concat(F.array(F.struct(F.col("ticker").alias("f"), F.lit(1.0).alias("c"))), F.transform(F.coalesce("variants", F.array().cast("array<string>")), lambda v: F.struct(v.alias("f"), F.lit(0.95).alias("c")))))
    rows = tickers.select("canonical_id", F.col("company_name").alias("canonical_label"), forms.alias("x"))
    return rows.select(entry_id(version, F.col("canonical_id"), F.col("x.f")).alias("entry_id"), F.col("x.f").alias("surface_form"), "canonical_id", "canonical_label", F.lit("ticker").alias("entry_type"), F.col("x.c").alias("confidence"))


def entries_of_abbreviations(abbreviations: DataFrame, version: str = "v1") -> DataFrame:
    """Lexicon entries of the abbreviations that stand for a metric."""
    rows = abbreviations.where(F.coalesce(F.col("metric_id"), F.lit("")) != "")
    return rows.select(entry_id(version, F.col("metric_id"), F.col("abbreviation")).alias("entry_id"), F.col("abbreviation").alias("surface_form"), F.col("metric_id").alias("canonical_id"), F.col("expansion").alias("canonical_label"), F.lit("abbreviation").alias("entry_type"), F.lit(1.0).alias("confidence"))


def expand_abbreviations(tokens: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """``token``, ``expansion``, ``metric_id``: the first of the list on ties."""
    asked = settle(tokens.select("token").distinct(), "tokens").hint("merge")  # distinct words; the texts they come from may be estimated as small
    hit = asked.join(abbreviations.withColumn("up", F.upper(F.trim("abbreviation"))), F.upper(F.trim("token")) == F.col("up"))
    return first_wins(hit, ["token"], [F.asc("seq")]).select("token", "expansion", "metric_id")


def bumped(entries: DataFrame, version: str) -> DataFrame:
    """The entries under a new version's ids."""
    return entries.withColumn("entry_id", entry_id(version, F.col("canonical_id"), F.col("surface_form")))


def merged_aliases(old: Column, new: Column) -> Column:
    """``old`` and those of ``new`` that aren't there in any case; of new ones that differ in case alone, the first."""
    low = F.transform(old, lambda x: F.lower(x))
    fresh = F.filter(new, lambda x: ~F.array_contains(low, F.lower(x)))
    firsts = F.filter(F.transform(fresh, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.array_position(F.transform(fresh, lambda y: F.lower(y)), F.lower(s["x"])) == s["i"] + 1)
    return F.concat(old, F.transform(firsts, lambda s: s["x"]))
