"""Two vectors of each text, plain and behind its context, by models that carry their version."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import truncated
from .vector import EMBEDDING_DIMS, conditioned, hashed_embedding


@dataclass(frozen=True)
class Model:
    """An embedding model: ``embed`` makes a column of vectors out of a column of texts; ``dims``, if set, cuts them short."""

    provider: str
    name: str
    dimensions: int
    embed: Callable[[Column], Column] = field(default=lambda text: hashed_embedding(tokens(text)))
    dims: int | None = None

    def cut(self, vector: str) -> Column:
        return (F.col(vector) if self.dims is None else truncated(vector, self.dims)).alias(vector)

    @property
    def size(self) -> int:
        return self.dims or self.dimensions


#: The offline model.
HASHED = Model("local", "hashed-words", EMBEDDING_DIMS)


def dual_vectors(chunks: DataFrame, context: list[str], narrative: Model = HASHED, entity: Model = HASHED) -> DataFrame:
    """``chunk_id``, ``narrative``, ``entity_schema`` (vectors) and their numbers of words, of chunks (chunk_id, text, ...).

    The second vector is that of the text behind its ``context`` columns in brackets. Each model names
    itself in ``narrative_model`` and ``entity_model``, so that vectors of unlike versions aren't mixed.
    A null text is read as empty.
    """
    text = F.coalesce("text", F.lit(""))
    said = conditioned(text, *[F.col(c).cast("string") for c in context])
    rows = chunks.select("chunk_id", text.alias("_plain"), said.alias("_said"))
    count = lambda c: F.size(tokens(F.col(c))).cast("long")
    made = _embedded(rows.withColumns({"narrative_words": count("_plain"), "entity_words": count("_said")}), narrative, entity)
    return made.select("chunk_id", narrative.cut("narrative"), entity.cut("entity_schema"), "narrative_words", "entity_words", F.lit(model_id(narrative)).alias("narrative_model"), F.lit(model_id(entity)).alias("entity_model"))


def _embedded(rows: DataFrame, narrative: Model, entity: Model) -> DataFrame:
    """The vectors of ``_plain`` and ``_said``, in one pass through Python, in place of the texts; uncut, as Python results don't go into lambdas."""
    return rows.withColumns({"narrative": narrative.embed(F.col("_plain")), "entity_schema": entity.embed(F.col("_said"))}).drop("_plain", "_said")


def query_vectors(questions: DataFrame, narrative: Model = HASHED, entity: Model = HASHED) -> DataFrame:
    """``query_id`` and both vectors of questions (query_id, text, context): the second behind its context, where it isn't null or empty."""
    rows = questions.select("query_id", F.coalesce("text", F.lit("")).alias("_plain"), "context")
    made = _embedded(rows.select("query_id", "_plain", conditioned(F.col("_plain"), F.col("context")).alias("_said")), narrative, entity)
    return made.select("query_id", narrative.cut("narrative"), entity.cut("entity_schema"))


def model_id(model: Model) -> str:
    return f"{model.provider}:{model.name}:{model.size}"


def model_versions(spark: SparkSession, narrative: Model = HASHED, entity: Model = HASHED) -> DataFrame:
    """``channel``, ``provider``, ``model_name``, ``dimensions``: rows that versioning.registered() takes, with ``seq``."""
    rows = [(c, m.provider, m.name, m.size, i) for i, (c, m) in enumerate((("narrative", narrative), ("entity_schema", entity)))]
    return spark.createDataFrame(rows, "channel string, provider string, model_name string, dimensions int, seq int")
