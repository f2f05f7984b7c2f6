"""Words into overlapping chunks, texts into sections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.scratch import settle

#: Words of a chunk, and of the overlap of two, from 512 and 64 tokens at 1.3 tokens a word.
CHUNK_WORDS, OVERLAP_WORDS = int(512 / 1.3), int(64 / 1.3)
#: Headings of sections of filings, as (name, pattern); case is ignored, so that variants of it are left out.
FILING_SECTIONS = (
    ("Risk Factors", r"Item\s+1[A.]?\s*[-–—:]?\s*Risk\s+Factors"),
    ("MD&A", r"Item\s+7[A.]?\s*[-–—:]?\s*Management.?s\s+Discussion"),
    ("Business", r"Item\s+1\s*[-–—:]?\s*Business"),
    ("Properties", r"Item\s+2\s*[-–—:]?\s*Properties"),
    ("Legal Proceedings", r"Item\s+3\s*[-–—:]?\s*Legal"),
    ("Market for Stock", r"Item\s+5\s*[-–—:]?\s*Market"),
    ("Selected Financial Data", r"Item\s+6\s*[-–—:]?\s*Selected\s+Financial"),
    ("Financial Statements", r"Item\s+8\s*[-–—:]?\s*Financial\s+Statements"),
    ("Changes and Disagreements", r"Item\s+9\s*[-–—:]?\s*Changes"),
    ("Forward-Looking Statements", r"Forward[- ]Looking\s+Statements"),
    ("Notes to Financial Statements", r"Notes?\s+to\s+(?:Consolidated\s+)?Financial\s+Statements"),
    ("Prepared Remarks", r"Prepared\s+Remarks"),
    ("Q&A Session", r"(?:Q(?:uestion)?[&\s]+A(?:nswer)?|Q&A)\s*(?:Session)?"),
    ("Opening Remarks", r"Opening\s+Remarks"),
    ("Closing Remarks", r"(?:Closing|Concluding)\s+Remarks"),
)
#: Fixed value: a speaker's line in a transcript.
SPEAKER = r"(?m)^([A-Z][a-z]+ [A-Z][a-z]+)\s*[-–—]+\s*(.+)$"


def chunk_count(n_words: Column, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> Column:
    """0 without words, 1 up to ``size`` of them, else one more for each further ``size - overlap``."""
    return F.when(n_words <= 0, 0).when(n_words <= size, 1).otherwise(1 + F.ceil((n_words - size) / F.lit(size - overlap))).cast("long")


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """``doc_id``, ``chunk_index``, ``chunk_id``, ``n_words``, ``text``: narrow, each document in its place."""
    rows = docs.select(F.col(id_col).alias("doc_id"), T.words(text_col).alias("w")).withColumn("n", chunk_count(F.size("w"), size, overlap)).where("n > 0")
    rows = rows.select("doc_id", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("chunk_index"))
    part = F.slice(F.col("w"), (F.col("chunk_index") * (size - overlap) + 1).cast("int"), F.lit(size))
    return rows.select("doc_id", "chunk_index", F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("chunk"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.size(part).cast("long").alias("n_words"), F.array_join(part, " ").alias("text"))


def _first_word(pattern: str) -> str | None:
    """The plain letters that a match of a pattern begins with, in lower case: most texts don't hold them. None where there are alternatives."""
    word = re.match(r"[A-Za-z]{3,}(?![?*{|A-Za-z])", pattern)
    return word[0].lower() if word and not _alternatives(pattern) else None


def _alternatives(pattern: str) -> bool:
    """Whether a | stands outside of all brackets."""
    depth = 0
    for ch in re.sub(r"\\.|\[[^\]]*\]", "", pattern):
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0:
            return True
    return False


def sections(docs: DataFrame, patterns: tuple[tuple[str, str], ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``section``, ``start``, ``end`` (characters from 0): from each match of a heading to the next one's of any.

    A pattern's matches start after the parts that it splits the text into and the matches between
    them: lengths alone are summed up, along each text. Matches at one place go by the order of their names.
    """
    c = F.col(text_col)
    sizes = lambda of: F.transform(of, F.length)
    none = F.array().cast("array<int>")
    may = lambda p, found: F.when(F.col("_low").contains(word), found).otherwise(none) if (word := _first_word(p)) else found
    each = F.array(*[F.struct(F.lit(n).alias("section"), may(p, sizes(F.split(c, "(?is)" + p, -1))).alias("parts"), may(p, sizes(F.regexp_extract_all(c, F.lit("(?is)" + p), F.lit(0)))).alias("matches")) for n, p in patterns])
    rows = docs.withColumn("_low", F.lower(c)).select(F.col(id_col).alias("doc_id"), F.length(c).cast("long").alias("size"), F.inline(each)).where(F.size("matches") > 0)
    rows = rows.select("doc_id", "size", "section", F.posexplode(F.arrays_zip("parts", "matches")).alias("i", "x")).where("x.matches is not null")
    before = Window.partitionBy("doc_id", "section").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.col("x.parts") + F.col("x.matches")).over(before) - F.col("x.matches")
    rows = rows.withColumn("start", start.cast("long"))
    end = F.coalesce(F.lead("start").over(Window.partitionBy("doc_id").orderBy("start", "section")), F.col("size"))
    return rows.select("doc_id", "section", "start", end.alias("end"))


def filing_type(text: Column) -> Column:
    """10-K, 10-Q or 8-K, from the first 2000 characters; 10-K where they don't say."""
    head = F.lower(F.substring(text, 1, 2000))
    has = lambda *x: F.lit(False) if not x else has(*x[1:]) | head.contains(x[0])
    return F.when(has("annual report", "form 10-k"), "10-K").when(has("quarterly report", "form 10-q"), "10-Q").when(has("form 8-k"), "8-K").otherwise("10-K")


def speakers(text: Column) -> Column:
    """Distinct names that start a line before a dash, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(SPEAKER), F.lit(1)))


#: First headings of the parts of an annual report, and of a call.
ANNUAL_PARTS = (
    ("item_1", r"(?:ITEM\s*1[.\s]|Part\s+I\b)[^\n]*?Business"),
    ("item_1a", r"ITEM\s*1A[.\s][^\n]*?Risk\s*Factors"),
    ("item_2", r"ITEM\s*2[.\s][^\n]*?Properties"),
    ("item_3", r"ITEM\s*3[.\s][^\n]*?Legal\s*Proceedings"),
    ("item_5", r"ITEM\s*5[.\s][^\n]*?Market[^\n]*?(?:Registrant|Equity)"),
    ("item_6", r"ITEM\s*6[.\s][^\n]*?(?:Selected|Reserved)"),
    ("item_7", r"ITEM\s*7[.\s][^\n]*?(?:MD&?A|Management[^\n]*?Discussion)"),
    ("item_7a", r"ITEM\s*7A[.\s][^\n]*?(?:Quantitative|Market\s*Risk)"),
    ("item_8", r"ITEM\s*8[.\s][^\n]*?Financial\s*Statements"),
    ("item_9", r"ITEM\s*9[.\s][^\n]*?(?:Changes|Disagreements)"),
)
CALL_PARTS = (
    ("prepared_remarks", r"(?:prepared\s+remarks|opening\s+remarks|presentation)"),
    ("ceo_remarks", r"(?:CEO|Chief\s+Executive\s+Officer)[^\n]*?(?:remarks|comments)"),
    ("cfo_remarks", r"(?:CFO|Chief\s+Financial\s+Officer)[^\n]*?(?:remarks|comments)"),
    ("qa_session", r"(?:Q(?:uestion)?[\s&]+A(?:nswer)?|question.and.answer)\s*(?:session)?"),
)


def parsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", type_col: str = "doc_type") -> DataFrame:
    """``doc_id``, ``doc_type``, ``section``, ``start``, ``end`` of cleaned texts, by the document's type.

    Filings without a type get one from their text. Annual reports and calls have their parts; all
    other documents, and those without a part, are one section ``full``.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), T.clean_text(text_col).alias("text"), F.col(type_col).alias("doc_type"))
    rows = rows.withColumn("doc_type", F.coalesce("doc_type", filing_type(F.col("text"))))
    found = None
    for kind, parts in (("10-K", ANNUAL_PARTS), ("earnings_transcript", CALL_PARTS)):
        some = sections(rows.where(F.col("doc_type") == kind), parts)
        found = some if found is None else found.unionByName(some)
    whole = rows.select("doc_id", F.lit("full").alias("section"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end")).join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    return found.unionByName(whole).join(rows.select("doc_id", "doc_type"), "doc_id")


def structural_chunks(docs: DataFrame, patterns: tuple[tuple[str, str], ...] = FILING_SECTIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of each section, numbered on through the document; texts without a section are chunked whole.

    Text before the first section is left out, as is a section without a word.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parts = settle(sections(rows, patterns), "sections")  # for the texts with sections, and for those without
    cut = parts.join(rows, "doc_id").select("doc_id", "section", "start", F.expr("substring(text, start + 1, end - start)").alias("text"))
    whole = rows.join(parts.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit("").alias("section"), F.lit(0).cast("long").alias("start"), "text")
    made = chunks(cut.unionByName(whole).withColumn("k", F.struct("doc_id", "start", "section")), "k", "text").select("doc_id.*", F.col("chunk_index").alias("i"), "n_words", "text")
    at = Window.partitionBy("doc_id").orderBy("start", "i")
    out = made.withColumn("chunk_index", (F.row_number().over(at) - 1).cast("long"))
    return out.select("doc_id", "section", "chunk_index", F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("chunk"), F.col("chunk_index").cast("string")).alias("chunk_id"), "n_words", "text")
