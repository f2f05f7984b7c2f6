"""Queries that put operators together: tables of companies, ingestion, registries, whole answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions import tokens
from ..operators import finance, lexical, vector, versioning
from . import expansion
from . import ingest as ingestion
from . import retrieval
from .catalog import Tables, query
from .ops_queries import _ST, statements
from .retrieval_queries import _RANK, _bm25_sql, entries, terms, tickers
from .text_queries import WORDS, questions


@query(f"""with {_ST}, l as (select company, max(year) as year, arg_max(revenue, year) as revenue from st group by company)
select c_custkey, c_name, year, case when revenue is null then 'N/A' else printf('%.1f%%', round(revenue / 10000, 1)) end as share from customer left join l on company = c_custkey""")
def company_table(t: Tables) -> DataFrame:
    """All companies, with N/A where there is no statement."""
    last = finance.latest(statements(t).select("company", "year", "revenue"), "company")
    rows = t.customer.join(last, F.col("c_custkey") == F.col("company"), "left")
    return rows.select("c_custkey", "c_name", "year", N.percent(F.round(F.col("revenue") / 10000, 1) / 100).alias("share"))


@query(f"with {_ST} select c_custkey, c_name, year, round(revenue, 2) as revenue, round(net_income, 2) as net_income from customer join st on company = c_custkey")
def company_export(t: Tables) -> DataFrame:
    """Only companies with statements."""
    rows = t.customer.join(statements(t), F.col("c_custkey") == F.col("company"))
    return rows.select("c_custkey", "c_name", "year", F.round("revenue", 2).alias("revenue"), F.round("net_income", 2).alias("net_income"))


@query(f"with {_bm25_sql()}, top as (select query_id, doc_id from scored qualify {_RANK} <= 10) select query_id, round(avg(case when quality is not null then 1.0 else 0.0 end), 6) as coverage, count(*) as n from top left join labels using (doc_id) group by query_id")
def provenance_coverage(t: Tables) -> DataFrame:
    top = lexical.bm25_top(t.documents, terms(t), 10).join(t.labels, "doc_id", "left")
    return finance.coverage(top, F.col("quality").isNotNull())


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n', chr(10), 'g'), '\t', ' ', 'g'), ' {2,}', ' ', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"""with c as (select doc_id, {_CLEAN} as text, source from documents), g as (select * from c where length(trim(text)) > 0), n as (select doc_id, len({WORDS}) as n from g)
select (select count(*) from c) as documents, (select count(*) from g) as accepted, (select count(*) from c where length(trim(text)) = 0) + (select count(*) from c where length(trim(text)) > 0 and length(text) < 50) + (select count(*) from c where coalesce(source, '') = '') as issues,
(select sum(case when n = 0 then 0 when n <= 393 then 1 else 1 + cast(ceil((n - 393) / 344.0) as bigint) end)::bigint from n) as chunks""")
def ingestion_stats(t: Tables) -> DataFrame:
    return ingestion.ingest(t.documents, "run:1").stats


@query("""with r as (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as up, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as down from orders)
select o_custkey, o_orderkey as signal, o_totalprice as score, up as rank, 'strength' as side from r where up <= 3 union all select o_custkey, o_orderkey, o_totalprice, down, 'weakness' from r where down <= 3""")
def best_signals(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", F.col("o_orderkey").alias("signal"), F.col("o_totalprice").alias("score"))
    return finance.best_signals(rows, "o_custkey", "score")


@query("""with m as (select p_brand || ':' || p_type as model_id, arg_max(p_size, p_partkey) as dimensions from part group by 1)
select model_id, dimensions, substr(sha256(model_id || ':' || dimensions), 1, 12) as hash, model_id not in (select p_brand || ':' || p_type from part where p_size = 50) as active from m""")
def model_registry(t: Tables) -> DataFrame:
    models = t.part.select(F.col("p_brand").alias("provider"), F.col("p_type").alias("model_name"), F.col("p_size").alias("dimensions"), F.col("p_partkey").alias("seq"))
    off = t.part.where("p_size = 50").select(F.concat_ws(":", "p_brand", "p_type").alias("model_id"))
    return versioning.deactivated(versioning.registered(models), off).select("model_id", "dimensions", "hash", "active")


@query()
def narrative_kinds(t: Tables) -> DataFrame:
    """Typed tokens of all documents, counted by kind and normal form; tests hold the scan against its definition.

    Equal words are counted before they are brought to their normal form.
    """
    found = t.documents.select(F.explode(tokens.narrative_spans("text")).alias("k")).groupBy("k.kind", "k.text").agg(F.count("*").alias("n"))
    found = found.withColumn("kind", tokens.narrative_kind(F.col("kind"), F.col("text"))).withColumn("normalized", tokens.narrative_form(F.col("kind"), F.col("text")))
    return found.groupBy("kind", "normalized").agg(F.sum("n").alias("n"))


@query()
def lsh_knn(t: Tables) -> DataFrame:
    """Approximate neighbours; tests measure the recall against the exact ones."""
    return vector.lsh_nearest(t.embeddings, t.embeddings.where("vec_id % 100 = 0"), 10)


def _expanded(t: Tables) -> DataFrame:
    e = entries(t)
    short = t.part.groupBy(F.substring("p_brand", 1, 3).alias("abbreviation")).agg(F.min("p_type").alias("expansion"), F.min("p_brand").alias("metric_id"), F.min("p_partkey").alias("seq"))
    mapped = e.select("surface_form", F.col("canonical_id").alias("concept"), F.lit("custom").alias("taxonomy"), F.col("canonical_label").alias("label"), "confidence")
    return expansion.expanded(questions(t).select(F.col("question_id").alias("query_id"), "text"), e, tickers(t), short, mapped)


@query()
def expand_full(t: Tables) -> DataFrame:
    """All questions with companies, periods and further terms; tests hold the steps against brute force."""
    return _expanded(t)


@query()
def answer_questions(t: Tables) -> DataFrame:
    """The whole way from the benchmark's items as questions to explained hits, with hashed word counts as vectors."""
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    embed = lambda df, i: df.select(F.col(i), vector.hashed_embedding(T.tokens("text")).alias("embedding"))
    vectors = embed(t.documents, "doc_id").withColumnRenamed("doc_id", "item")
    return retrieval.answer(asked, t.documents, vectors, embed(asked, "query_id"))
