"""Readers: documents, companies, statements, lexicons, judgments, filings."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import top_k

COMPANY = "canonical_id string, name string, ticker string, exchange string, cik string, isin string, sector string, industry string, country string, aliases array<string>, description string"
LEXICON = (
    "version string, entries array<struct<entry_id:string,surface_form:string,canonical_id:string,canonical_label:string,entry_type:string,language:string,confidence:double>>, "
    "tickers array<struct<canonical_id:string,ticker:string,exchange:string,company_name:string,variants:array<string>>>, "
    "abbreviations array<struct<abbreviation:string,expansion:string,metric_id:string,category:string>>, "
    "schema_mappings array<struct<surface_form:string,concept:string,taxonomy:string,label:string,confidence:double>>"
)
STATEMENT = "map<string,struct<income_statement:map<string,double>,balance_sheet:map<string,double>,cash_flow:map<string,double>>>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An object or an array of objects for each file; fields that are missing are null."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """Text columns in the file's order, with a header."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, header=True, sep=sep)


def read_folder(spark: SparkSession, path: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """All files that match, in one frame with ``file``; records that can't be read are dropped, broken files skipped."""
    rows = spark.read.schema(schema).option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True).option("mode", "DROPMALFORMED").json(path, multiLine=True)
    return rows.withColumn("file", F.col("_metadata.file_name"))


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """Companies with an ``identifiers`` array of those that are there; the id falls back to the ticker, the country to US."""
    rows = read_json(spark, path, COMPANY)
    ident = lambda kind, c, primary: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct(F.lit(kind).alias("id_type"), F.col(c).alias("value"), F.col("exchange").alias("exchange"), F.lit(primary).alias("primary")))
    found = F.array_compact(F.array(ident("ticker", "ticker", True), ident("cik", "cik", False), ident("isin", "isin", False)))
    return rows.select(
        F.coalesce(F.when(F.col("canonical_id") != "", F.col("canonical_id")), "ticker").alias("company_id"),
        "name", found.alias("identifiers"), "sector", "industry", F.coalesce("country", F.lit("US")).alias("country"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "description",
    )


def primary_ticker(identifiers: Column) -> Column:
    """The first primary ticker, else the first ticker."""
    tickers = F.filter(identifiers, lambda x: x["id_type"] == "ticker")
    return F.coalesce(F.get(F.filter(tickers, lambda x: x["primary"]), 0)["value"], F.get(tickers, 0)["value"])


def read_statements(spark: SparkSession, path: str, company_id: str) -> DataFrame:
    """``company_id``, ``year``, ``statement``, ``metric``, ``value`` of a file keyed by year."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", STATEMENT).alias("m")).select(F.explode("m").alias("year", "s"))
    kinds = [F.struct(F.lit(k).alias("statement"), F.col(f"s.{k}").alias("values")) for k in ("income_statement", "balance_sheet", "cash_flow")]
    long = rows.select("year", F.inline(F.array(*kinds))).select("year", "statement", F.explode("values").alias("metric", "value"))
    return long.select(F.lit(company_id).alias("company_id"), F.col("year").try_cast("int").alias("year"), "statement", "metric", "value")


def read_metrics_csv(spark: SparkSession, path: str, company_id: str, metrics: list[str]) -> DataFrame:
    """A file of (period, metric, value) as one row for each period that has revenue; numbers that can't be read are skipped, and of a metric's values for a period the last in the file holds."""
    rows = read_csv(spark, path, ["period", "metric", "value"]).withColumn("seq", F.monotonically_increasing_id())  # in the order of the file
    rows = rows.withColumn("value", F.col("value").try_cast("double")).where("value is not null")
    wide = rows.groupBy("period").pivot("metric", metrics).agg(F.max_by("value", "seq")).where("revenue is not null")
    return wide.select(F.lit(company_id).alias("company_id"), "*")


def parse_json(text: Column, schema: str) -> Column:
    """Array of records of a JSON literal, which is one object or an array of them; null where it is broken."""
    return F.from_json(text, f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})


#: A record of a CSV literal: quoted parts, which may hold line ends, and others. Possessive, as no part can be read in two ways.
CSV_RECORD = r'(?:"[^"]*+"|[^"\r\n]++)++'


def parse_csv(text: Column, columns: list[str], sep: str = ",") -> Column:
    """Array of records (text fields ``columns``, in the header's order) of a CSV literal with a header; empty lines count for nothing.

    A record with fewer fields has nulls at its end; more than ``columns`` are left out. Null for a null literal.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    records = F.regexp_extract_all(text, F.lit(CSV_RECORD), F.lit(0))
    body = F.slice(records, F.lit(2), F.greatest(F.size(records) - 1, F.lit(0)))
    return F.transform(body, lambda r: F.from_csv(r, schema, {"sep": sep, "escape": '"', "multiLine": "true"}))


def seed_lexicon(spark: SparkSession) -> dict[str, DataFrame]:
    """The tables of the library's own small lexicon, as read_lexicon() gives them. The file is of a fixed size and goes with the plan."""
    text = (Path(__file__).parent / "seed_lexicon.json").read_text()
    one = spark.range(1).select(F.from_json(F.lit(text), LEXICON).alias("x")).select("x.*")
    return _lexicon_tables(one)


def read_lexicon(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four tables of a lexicon file; ``seq`` is a row's place in its list."""
    return _lexicon_tables(read_json(spark, path, LEXICON))


def _lexicon_tables(rows: DataFrame) -> dict[str, DataFrame]:
    part = lambda name: rows.select("version", F.posexplode(name).alias("seq", "x")).select("version", "seq", "x.*")
    return {name: part(name) for name in ("entries", "tickers", "abbreviations", "schema_mappings")}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files; ``doc_id`` is the name without its ending."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("doc_id"), F.col("value").alias("text"))


def read_judgments(spark: SparkSession, queries_path: str, qrels_path: str) -> tuple[DataFrame, DataFrame]:
    """Queries and judgments from tab-separated files; rows with too few fields or no whole-number grade are
    dropped, and judgments of unknown queries."""
    raw = lambda p: spark.read.text(p).select(F.split("value", "\t").alias("f"))
    queries = raw(queries_path).where(F.size("f") >= 2).select(F.col("f")[0].alias("query_id"), F.col("f")[1].alias("text"))
    rels = raw(qrels_path).where(F.size("f") >= 3).select(F.col("f")[0].alias("query_id"), F.col("f")[1].alias("item"), F.col("f")[2].try_cast("int").alias("rel")).where("rel is not null")
    return queries, rels.join(queries.select("query_id"), "query_id", "left_semi")


def filings(raw: DataFrame, kind: str, most: int) -> DataFrame:
    """Rows of parallel arrays (accession, form, date, document) of one form, the first ``most`` of each company."""
    rows = raw.select("cik", F.posexplode(F.arrays_zip("accession", "form", "date", "document")).alias("pos", "x")).where(F.col("x.form") == kind)


    kept = top_k(rows, ["cik"], [F.asc("pos")], most)
    return kept.select(F.lpad(F.regexp_replace("cik", "^0+", ""), 10, "0").alias("cik"), "x.*")


def search_hits(raw: DataFrame) -> DataFrame:
    """Rows of saved search answers with ``hits.hits``."""
    return raw.select(F.explode("hits.hits").alias("h")).select("h.*")
