"""Registries of models, lexicons and index generations as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import short_hash
from .ranking import last_wins


def registered(models: DataFrame) -> DataFrame:
    """Models (provider, model_name, dimensions, seq) with ``model_id``, ``hash`` and ``active``; the last row of an id counts."""
    rows = models.withColumn("model_id", F.concat_ws(":", "provider", "model_name"))
    rows = rows.withColumns({"hash": short_hash(F.concat_ws(":", "provider", "model_name", F.col("dimensions").cast("string"))), "active": F.lit(True)})
    return last_wins(rows, ["model_id"], "seq")


def deactivated(models: DataFrame, ids: DataFrame) -> DataFrame:
    """``active`` false for the ids given."""
    off = ids.select("model_id").distinct().withColumn("_off", F.lit(True))
    return models.join(off, "model_id", "left").withColumn("active", F.col("active") & F.col("_off").isNull()).drop("_off").select(*models.columns)


def first_active(generations: DataFrame, seq: str = "seq") -> DataFrame:
    """The first active generation, in the order of registration."""
    return generations.where("status = 'active'").orderBy(seq).limit(1)


def state_rows(models: DataFrame, lexicons: DataFrame, generations: DataFrame) -> DataFrame:
    """The whole registry as rows (kind, json)."""
    part = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("json"))
    return part(models, "model").unionByName(part(lexicons, "lexicon")).unionByName(part(generations, "generation"))


def restored(state: DataFrame, kind: str, schema: str) -> DataFrame:
    """One registry back from its rows; fields that are missing are null."""
    return state.where(F.col("kind") == kind).select(F.from_json("json", schema).alias("x")).select("x.*")
