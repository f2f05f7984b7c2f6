"""Typed tokens with their places in the text: the one text function that needs Python, as it needs offsets.

The scans give kinds, offsets and texts, as Spark would walk from a text's start to each offset; kinds of
words and normal forms are columns.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import as_column
from .text import ABBREVIATIONS, stem

#: Patterns of periods, numbers and currencies, of securities, and of words.
TYPED = re.compile(
    r"(?P<period>(?i:\b(?:FY|CY|Q[1-4]|H[12]|TTM|LTM|YTD|MRQ)\s*\d{0,4}\b))"
    r"|(?P<number>(?<!\w)[-+]?\$?\d[\d,]*\.?\d*[BMKbmk%]?(?!\w))"
    r"|(?P<currency>\b(?:USD|EUR|GBP|JPY|CNY|INR|KRW|CHF|CAD|AUD|HKD)\b)"
)
SECURITY = re.compile(r"(?P<isin>\b[A-Z]{2}[A-Z0-9]{9}\d\b)|(?P<ticker>\b[A-Z]{1,5}(?:\.[A-Z]{1,2})?\b)")
WORD = re.compile(r"\b[\w&/]+\b")
PART = re.compile(r"\S+")
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("text", T.StringType())]))
#: Texts that are scanned at once.
SLICE = 256


def spans(text: str, typed: re.Pattern, other: re.Pattern) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what ``typed`` finds, by the name of its group, and as ``word`` what ``other`` finds that doesn't start within that; by start."""
    found = [(m.lastgroup, m.start(), m.end()) for m in typed.finditer(text)]
    starts, ends = [s for _, s, _ in found], [e for _, _, e in found]
    for m in other.finditer(text):
        before = bisect_right(starts, m.start()) - 1
        if before < 0 or ends[before] <= m.start():
            found.append(("word", m.start(), m.end()))
    return sorted(found, key=lambda x: x[1])


def _scan(texts: pa.Array, typed: re.Pattern, other: re.Pattern) -> pa.Array:
    parts = []
    for at in range(0, max(1, len(texts)), SLICE):
        some = texts.slice(at, SLICE).to_pylist()
        found = [None if t is None else spans(t, typed, other) for t in some]
        rows = [(*x, t[x[1] : x[2]]) for t, f in zip(some, found, strict=True) for x in f or ()]
        ends = [0]
        for f in found:
            ends.append(ends[-1] + len(f or ()))
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))]
        parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["kind", "start", "end", "text"]), mask=pa.array([f is None for f in found], pa.bool_())))
    return pa.concat_arrays(parts)


@F.arrow_udf(SPAN)
def _narrative(texts: pa.Array) -> pa.Array:
    return _scan(texts, TYPED, WORD)


@F.arrow_udf(SPAN)
def _securities(texts: pa.Array) -> pa.Array:
    return _scan(texts, SECURITY, PART)


def _token(x: Column, kind: Column, plain: Column) -> Column:
    return F.struct(x["text"].alias("text"), kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), plain.alias("normalized"))


def narrative_spans(text) -> Column:
    """Array of (kind, start, end, text) as scanned: periods, numbers, currencies and words."""
    return _narrative(as_column(text))


def narrative_kind(kind: Column, word: Column) -> Column:
    """The kind of a scanned span: of words, whether it is an abbreviation."""
    return F.when(kind != "word", kind).when(F.upper(word).isin(ABBREVIATIONS), "identifier").otherwise("narrative")


def narrative_form(kind: Column, word: Column) -> Column:
    """The normal form of a word of that kind."""
    return F.when(kind == "period", F.replace(F.upper(word), F.lit(" "), F.lit(""))).when(kind == "number", F.replace(word, F.lit(","), F.lit(""))).when(kind == "narrative", stem(F.lower(word))).otherwise(F.upper(word))


def narrative_tokens(text) -> Column:
    """Array of (text, kind, start, end, normalized): periods, numbers, currencies, identifiers (abbreviations) and narrative words, which are stemmed."""
    kind = lambda x: narrative_kind(x["kind"], x["text"])
    return F.transform(narrative_spans(text), lambda x: _token(x, kind(x), narrative_form(kind(x), x["text"])))


def identifier_spans(text) -> Column:
    """Array of (text, kind, start, end, normalized) of security numbers, tickers, and what else stands between white space, all in capitals."""
    return F.transform(_securities(as_column(text)), lambda x: _token(x, F.lit("identifier"), F.upper(x["text"])))


def schema_spans(text) -> Column:
    """Array of (text, kind, start, end, normalized) of the parts of a controlled name, in lower case and not stemmed.

    Places are those in the trimmed text with one character for each run of separators.
    """
    parts = F.split(F.lower(F.trim(as_column(text))), r"[:/\-_\s]+")

    def token(part: Column, i: Column) -> Column:
        start = (F.length(F.array_join(F.slice(parts, F.lit(1), i), " ")) + F.when(i > 0, 1).otherwise(0)).cast("long")
        return F.struct(part.alias("text"), F.lit("schema").alias("kind"), start.alias("start"), (start + F.length(part)).alias("end"), part.alias("normalized"))

    return F.filter(F.transform(parts, token), lambda t: t["text"] != "")


def typed_tokens(text, field: str | Column) -> Column:
    """The tokens of a field by its type: ``identifier``, ``schema``, or any other as narrative.

    The type may be a column; each row then takes the tokens of its own type, and a scan in Python
    gets null for the rows that don't need it.
    """
    if isinstance(field, str):
        return {"identifier": identifier_spans, "schema": schema_spans}.get(field, narrative_tokens)(text)
    c, kind = as_column(text), F.coalesce(field, F.lit("narrative"))
    only = lambda wanted: F.when(wanted, c)
    plain = ~kind.isin("identifier", "schema")
    return F.coalesce(schema_spans(only(kind == "schema")), identifier_spans(only(kind == "identifier")), narrative_tokens(only(plain)))


def of_kind(tokens_: Column, *kinds: str) -> Column:
    """Of an array of tokens those of some kinds."""
    return F.filter(tokens_, lambda t: t["kind"].isin(*kinds))
