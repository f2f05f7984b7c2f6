"""Text functions as Spark columns: cleaning, tokens, stems, grams, periods, cues.

All of them stay in the JVM. ``nfc`` alone, which Spark has no function for, is a pandas UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .names import as_column

#: Letters, digits, underscore, ampersand and slash in any script: the same class in Java and RE2.
WORD = r"[\p{L}\p{N}_&/]+"
#: Characters and what replaces them.
REPLACED = {"\u2013": "-", "\u2014": "-", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u00a0": " "}
DROPPED = "\u200b\u200e\u200f\ufeff"
#: Suffix rules, the first that leaves three characters applies.
SUFFIXES = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ously", "ous"), ("ation", "ate"), ("ness", ""),
    ("ment", ""), ("able", ""), ("ible", ""), ("ally", "al"), ("ting", "t"), ("ing", ""), ("ied", "y"), ("ies", "y"), ("ely", "e"),
    ("ed", ""), ("ly", ""), ("er", ""), ("es", ""), ("s", ""),
)
#: English words that a search leaves out.
STOP_WORDS = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "below",
    "between", "both", "but", "by", "can", "did", "do", "does", "doing", "don", "down", "during", "each", "few", "for", "from", "further", "had", "has", "have",
    "having", "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "i", "if", "in", "into", "is", "it", "its", "itself", "just", "me",
    "more", "most", "my", "myself", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "ours", "ourselves", "out", "over",
    "own", "s", "same", "she", "should", "so", "some", "such", "t", "than", "that", "the", "their", "theirs", "them", "themselves", "then", "there", "these",
    "they", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who",
    "whom", "why", "will", "with", "you", "your", "yours", "yourself", "yourselves",
]
#: Abbreviations that are identifiers and aren't stemmed.
ABBREVIATIONS = [
    "EPS", "FCF", "EBITDA", "EBIT", "ROE", "ROA", "ROIC", "ROI", "P/E", "PE", "P/B", "PB", "P/S", "PS", "EV", "DCF",
    "WACC", "NIM", "NPL", "CAC", "LTV", "ARR", "MRR", "GMV", "TAM", "SAM", "SOM", "CAGR", "YOY", "QOQ", "MOM", "BPS",
    "SGA", "CAPEX", "OPEX", "IPO", "M&A", "ESG", "GDP", "CPI", "PPI", "TTM", "LTM", "MRQ", "FY", "CY", "NAV", "AUM",
]
#: Words that name a metric.
METRIC_WORDS = [
    "revenue", "sales", "income", "profit", "margin", "eps", "ebitda", "ebit", "fcf", "cash", "debt", "equity",
    "assets", "liabilities", "roe", "roa", "roic", "pe", "pb", "ps", "ev", "market", "cap", "dividend", "yield",
    "growth", "cagr", "gross", "operating", "net",
]
#: Cues of comparison, in the order in which they are tried, and of negation.
COMPARISONS = (
    ("compare", r"\bcompare\b|\bvs\.?\b|\bversus\b|\bagainst\b"),
    ("gt", r"\bgreater than\b|\babove\b|\bexceeds?\b|\b>\b"),
    ("lt", r"\bless than\b|\bbelow\b|\bunder\b|\b<\b"),
    ("between", r"\bbetween\b"),
    ("trend", r"\btrend\b|\bover time\b|\bhistorical\b"),
)
NEGATION = r"\bnot\b|\bno\b|\bnever\b|\bwithout\b|\bexclud(?:e|ing|es)\b|\bdeclin(?:e|ing|ed)\b"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition; needed only where texts hold combining marks."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def clean_text(text) -> Column:
    """Line ends to \\n, tabs to spaces, runs of spaces to one, no control characters, no outer space."""
    c = F.regexp_replace(as_column(text), "\r\n", "\n")
    c = F.regexp_replace(F.regexp_replace(c, "\t", " "), " {2,}", " ")
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


#: Control characters that go; line ends and tabs stay.
CONTROL = r"(?![\n\r\t])\p{C}"


def plain_punctuation(text) -> Column:
    """Dashes, quotes, dots and spaces of typesetting as plain ones; marks of no width go."""
    c = F.translate(as_column(text), "".join(REPLACED) + DROPPED, "".join(REPLACED.values()))
    return F.replace(c, F.lit("…"), F.lit("..."))


def normalize_text(text) -> Column:
    """Plain punctuation, no control characters, one space between words, two line ends at most."""
    c = F.regexp_replace(plain_punctuation(text), CONTROL, "")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t\r\f\x0b]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def control_characters(text) -> Column:
    """How many control characters normalize_text() would remove."""
    return F.regexp_count(as_column(text), F.lit(CONTROL))


def normalization_issues(text) -> Column:
    """A line for each control character that normalize_text() removes, in order; marks of no width are no issue."""
    found = F.regexp_extract_all(plain_punctuation(text), F.lit(CONTROL), F.lit(0))
    return F.transform(found, lambda ch: F.format_string("removed control char U+%04X", F.ascii(ch)))


def normalization(text, language=None, default: str = "en") -> Column:
    """(original, normalized, language, issues) of a text; the ``default`` language where none is given."""
    c = as_column(text)
    spoken = F.lit(default) if language is None else F.coalesce(F.nullif(as_column(language), F.lit("")), F.lit(default))
    return F.struct(c.alias("original"), normalize_text(c).alias("normalized"), spoken.alias("language"), normalization_issues(c).alias("issues"))


def normalize_identifier(text) -> Column:
    """Trimmed, upper case, without brackets around."""
    return F.regexp_replace(F.upper(F.trim(as_column(text))), r"^[\[\(]+|[\]\)]+$", "")


def normalize_metric_name(text) -> Column:
    """Lower case, brackets and dots that aren't decimal points as spaces, single spaces."""
    c = F.regexp_replace(F.lower(as_column(text)), r"[()]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\.(?!\d)", " "), r"\s+", " "))


def words(text) -> Column:
    """The parts between white space."""
    return F.filter(F.split(as_column(text), r"\s+"), lambda w: w != "")


def fold_case(text) -> Column:
    """Lower case, but for words of up to six capital letters; single spaces between words."""
    bare = lambda w: F.regexp_replace(w, r"""^[.,;:!?()\[\]{}"']+|[.,;:!?()\[\]{}"']+$""", "")
    return F.array_join(F.transform(words(text), lambda w: F.when(bare(w).rlike(r"^\p{Lu}{1,6}$"), w).otherwise(F.lower(w))), " ")


def tokens(text) -> Column:
    """Lower-case words of WORD, in order."""
    return F.regexp_extract_all(F.lower(as_column(text)), F.lit(WORD), F.lit(0))


def stem(word) -> Column:
    """A light stem of a lower-case word: the first rule of SUFFIXES that fits; words of up to three characters stay."""
    c = as_column(word)
    out = F.when(F.length(c) <= 3, c)
    for suffix, put in SUFFIXES:
        out = out.when(c.endswith(suffix) & (F.length(c) - len(suffix) + len(put) >= 3), F.concat(F.substr(c, F.lit(1), F.length(c) - len(suffix)), F.lit(put)))
    return out.otherwise(c)


def schema_tokens(text) -> Column:
    """Lower-case parts between colons, slashes, hyphens, underscores and white space."""
    return F.filter(F.split(F.lower(F.trim(as_column(text))), r"[:/\-_\s]+"), lambda w: w != "")


def identifier_tokens(text) -> Column:
    """Words in capitals of one to five letters with an optional class after a dot."""
    return F.regexp_extract_all(as_column(text), F.lit(r"\b[A-Z]{1,5}(?:\.[A-Z]{1,2})?\b"), F.lit(0))


def token_kind(word) -> Column:
    """identifier (an abbreviation), number or narrative."""
    c = as_column(word)
    return F.when(F.upper(c).isin(ABBREVIATIONS), "identifier").when(c.rlike(r"^[0-9]+$"), "number").otherwise("narrative")


def trigrams(text) -> Column:
    """The distinct three-character windows of the lower-case text, with two spaces before and one after."""
    padded = F.concat(F.lit("  "), F.lower(as_column(text)), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def trigram_similarity(a, b) -> Column:
    """Shared over all distinct trigrams of two texts."""
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)).cast("double")


def ngrams(list_, n: int) -> Column:
    """Runs of n words, joined by spaces."""
    c = as_column(list_)
    spots = F.when(F.size(c) >= n, F.sequence(F.lit(1), F.size(c) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.array_join(F.slice(c, i, n), " "))


def token_estimate(text) -> Column:
    """Words times 1.3, rounded down."""
    return F.floor(F.size(words(text)) * F.lit(1.3)).cast("long")


def comparison(text) -> Column:
    """The first cue of COMPARISONS, or null."""
    out = None
    for name, pattern in COMPARISONS:
        hit = as_column(text).rlike("(?i)" + pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def has_negation(text) -> Column:
    return as_column(text).rlike("(?i)" + NEGATION)


def metric_mentions(list_) -> Column:
    """Of lower-case words, those that name a metric."""
    return F.filter(as_column(list_), lambda w: w.isin(METRIC_WORDS))


def periods(text) -> Column:
    """Array of (kind, label): fiscal years, quarters, calendar years, relative and comparative periods."""
    c = as_column(text)

    def found(pattern: str, kind: str, label) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit("(?i)" + pattern), F.lit(0)), lambda raw: F.struct(F.lit(kind).alias("kind"), label(raw).alias("label")))

    year = lambda raw: F.regexp_extract(raw, r"(\d+)$", 1)
    long_year = lambda raw: F.when(F.length(year(raw)) == 4, year(raw)).otherwise((year(raw).cast("int") + 2000).cast("string"))
    return F.concat(
        found(r"\b(?:FY|fiscal\s*year)\s*(?:\d{4})\b", "FY", lambda raw: F.concat(F.lit("FY"), year(raw))),
        found(r"\bQ[1-4]\s*['’]?\s*\d{2,4}\b", "Q", lambda raw: F.concat(F.lit("Q"), F.regexp_extract(raw, r"([1-4])", 1), F.lit(" "), long_year(raw))),
        found(r"\b[1-4]Q\s*['’]?\s*\d{2,4}\b", "Q", lambda raw: F.concat(F.lit("Q"), F.regexp_extract(raw, r"([1-4])", 1), F.lit(" "), long_year(raw))),
        found(r"\b20\d{2}\b", "CY", lambda raw: raw),
        found(r"\b(?:last|prior|previous|trailing)\s+(?:year|quarter|month)\b", "REL", F.upper),
        found(r"\b(?:TTM|LTM|NTM)\b", "REL", F.upper),
        found(r"\b(?:YoY|QoQ|MoM)\b", "COMP", F.upper),
    )
