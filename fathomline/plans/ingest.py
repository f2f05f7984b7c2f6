"""Ingestion: raw documents to issues, chunks, vectors and provenance, in one pass of DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, finance, graph_build, vector
from ..sources.scratch import settle


@dataclass
class Ingested:
    """What a run makes of its documents: ``stats`` has a row with their numbers."""

    issues: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    nodes: DataFrame
    edges: DataFrame
    stats: DataFrame


def ingest(docs: DataFrame, run: str, *, id_col: str = "doc_id", text_col: str = "text", company_col: str = "source", embed: Callable[[Column], Column] | None = None) -> Ingested:
    """Clean, check, chunk and embed documents; those with an error go no further.

    ``embed`` makes a vector of a column of tokens; by default, hashed word counts.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), T.clean_text(F.coalesce(F.col(text_col), F.lit(""))).alias("text"), F.col(company_col).alias("source"))
    rows = settle(rows, "cleaned")  # all that follows reads the clean text, and several parts do
    issues = settle(finance.issues(rows, "doc_id", finance.document_rules()), "issues")
    good = rows.join(issues.where("severity = 'error'").select("doc_id").distinct(), "doc_id", "left_anti")
    chunks = chunking.structural_chunks(good).join(good.select("doc_id", "source"), "doc_id")
    said = vector.conditioned(F.col("text"), F.col("source"), F.col("section"))
    make = embed or vector.hashed_embedding
    vectors = chunks.select("chunk_id", "doc_id", T.tokens(said).alias("w")).select("chunk_id", "doc_id", make(F.col("w")).alias("embedding"))
    spans = chunks.select("chunk_id", "doc_id", F.lit(0).alias("start"), F.length("text").alias("end"))
    titled = good.select("doc_id", F.concat_ws(" ", F.col("source"), F.col("doc_id").cast("string")).alias("title"), F.lit(run).alias("run"))
    nodes, edges = graph_build.provenance(titled, spans)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    stats = count(rows, "documents").crossJoin(count(good, "accepted")).crossJoin(count(issues, "issues")).crossJoin(count(chunks, "chunks"))  # single rows
    return Ingested(issues, chunks, vectors, nodes, edges, stats)
