"""Queries of statements, checks, monitoring, upkeep and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import finance, lexicon, monitoring, ranking
from ..sources import sinks
from ..streaming import windows
from .catalog import Tables, query


def statements(t: Tables) -> DataFrame:
    """Revenue, cost, gross profit and net income of each customer and year, in whole cents."""
    cents = lambda c: F.sum(F.round(c * 100).cast("long"))
    price = F.col("l_extendedprice")
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("company"), F.year("o_orderdate").cast("long").alias("year"))
    out = rows.agg((cents(price) / 100).alias("revenue"), (cents(price * 0.6) / 100).alias("cost"), (cents(price * 0.4) / 100).alias("gross_profit"), (cents(price * (F.col("l_discount") - F.col("l_tax"))) / 100).alias("net_income"))
    return out


_ST = """st as (select o_custkey as company, year(o_orderdate) as year, sum(cast(round(l_extendedprice * 100) as bigint)) / 100.0::double as revenue, sum(cast(round(l_extendedprice * 0.6::double * 100) as bigint)) / 100.0::double as cost,
sum(cast(round(l_extendedprice * 0.4::double * 100) as bigint)) / 100.0::double as gross_profit, sum(cast(round(l_extendedprice * (l_discount - l_tax) * 100) as bigint)) / 100.0::double as net_income from lineitem join orders on l_orderkey = o_orderkey group by all)"""


@query(f"with {_ST} select company, year, round(case when revenue <> 0 then (revenue - cost) / revenue end, 6) as gross_margin, round(case when revenue <> 0 then net_income / revenue end, 6) as net_margin from st")
def financial_ratios(t: Tables) -> DataFrame:
    return finance.ratios(statements(t)).select("company", "year", "gross_margin", "net_margin")


@query(f"with {_ST} select company, max(year) as year, round(arg_max(revenue, year), 2) as revenue, count(*) as n_years from st group by company")
def latest_by_year(t: Tables) -> DataFrame:
    s = statements(t).select("company", "year", "revenue")
    n = s.groupBy("company").agg(F.count("*").alias("n_years"))
    return finance.latest(s, "company").join(n, "company").select("company", "year", F.round("revenue", 2).alias("revenue"), "n_years")


@query(f"with {_ST}, u as (select company, year, unnest(['revenue', 'cost', 'net_income']) as metric, unnest([revenue, cost, net_income]) as value from st) select 'fact:' || company || ':' || metric || ':' || year as fact_id, company, metric, 'FY' || year as period, round(value, 2) as value from u where value <> 0")
def facts_unpivot(t: Tables) -> DataFrame:
    return finance.facts(statements(t), "company", ["revenue", "cost", "net_income"]).withColumn("value", F.round("value", 2))


@query("select o_custkey, max(case when o_orderstatus = 'F' then n end) as F, max(case when o_orderstatus = 'O' then n end) as O, max(case when o_orderstatus = 'P' then n end) as P from (select o_custkey, o_orderstatus, count(*) as n from orders group by all) group by o_custkey")
def metrics_pivot(t: Tables) -> DataFrame:
    long = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return finance.wide(long, ["o_custkey"], "o_orderstatus", "n", ["F", "O", "P"])


_SCORES = "sc as (select c_custkey, round(0.2 * s1 + 0.15 * s2 + 0.15 * s3 + 0.15 * s4, 6) / 0.65 as score from (select c_custkey, (c_custkey % 11)::double as s1, (c_nationkey % 10)::double as s2, ((c_acctbal + 1000) / 1100)::double as s3, (length(c_mktsegment) % 10)::double as s4 from customer))"
_GRADE = "case " + " ".join(f"when score >= {x} then '{g}'" for x, g in N.GRADES) + " else 'F' end"


def _scores(t: Tables) -> DataFrame:
    parts = [(F.col("c_custkey") % 11).cast("double"), (F.col("c_nationkey") % 10).cast("double"), (F.col("c_acctbal") + 1000) / 1100, (F.length("c_mktsegment") % 10).cast("double")]
    return t.customer.select("c_custkey", "c_nationkey", (finance.weighted_score(parts) / F.lit(0.65)).alias("score"))


@query(f"with {_SCORES} select c_custkey, round(cast(score as double), 4) as score, {_GRADE} as grade from sc")
def composite_score(t: Tables) -> DataFrame:
    return finance.graded(_scores(t)).select("c_custkey", F.round("score", 4).alias("score"), "grade")


@query(f"with {_SCORES}, r as (select c_custkey, c_nationkey, round(cast(score as double), 4) as score from sc join customer using (c_custkey)) select c_custkey, score, row_number() over (partition by c_nationkey order by score desc, c_custkey) as rank, round(percent_rank() over (partition by c_nationkey order by score, c_custkey), 6) as pct from r")
def company_ranking(t: Tables) -> DataFrame:
    """Both ranks by ranges: no nation is sorted in one task."""
    rows = _scores(t).withColumn("score", F.round("score", 4))
    rows = ranking.ranked_by_ranges(rows, ["c_nationkey"], [F.asc("score"), F.asc("c_custkey")], "place", "n")
    rows = rows.withColumn("pct", F.round(F.when(F.col("n") > 1, (F.col("place") - 1) / (F.col("n") - 1)).otherwise(0.0), 6))
    return ranking.ranked_by_ranges(rows, ["c_nationkey"], [F.desc("score"), F.asc("c_custkey")]).select("c_custkey", "score", "rank", "pct")


@query("""select c_custkey, unnest(list_filter([case when c_nationkey = 3 then 'error:missing_id' end, case when c_mktsegment = 'BUILDING' then 'error:missing_name' end, case when c_acctbal <= 0 then 'warning:no_identifiers' end], lambda x: x is not null)) as issue from customer""")
def validate_companies(t: Tables) -> DataFrame:
    """Customers as companies; some are made to lack an id, a name or identifiers."""
    rows = t.customer.select("c_custkey", F.when(F.col("c_nationkey") != 3, F.col("c_custkey")).alias("company_id"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).otherwise("").alias("name"), F.when(F.col("c_acctbal") > 0, F.array("c_phone" if "c_phone" in t.customer.columns else "c_name")).alias("identifiers"))
    return finance.issues(rows, "c_custkey", finance.company_rules()).select("c_custkey", N.key("severity", "rule").alias("issue"))


@query("select doc_id, unnest(list_filter([case when length(trim(text)) = 0 then 'error:empty_content' end, case when length(trim(text)) > 0 and length(text) < 50 then 'warning:short_content' end, case when coalesce(source, '') = '' then 'warning:no_company' end], lambda x: x is not null)) as issue from documents")
def validate_documents(t: Tables) -> DataFrame:
    return finance.issues(t.documents, "doc_id", finance.document_rules()).select("doc_id", N.key("severity", "rule").alias("issue"))


@query(f"with {_ST} select company, year, unnest(list_filter([case when revenue < 0 then 'error:negative_revenue' end, case when gross_profit <> 0 and revenue <> 0 and cost <> 0 and abs(gross_profit - (revenue - cost)) > 1 then 'warning:gross_profit_mismatch' end, case when revenue <> 0 and abs(net_income / revenue) > 0.05 then 'warning:net_margin_outside' end], lambda x: x is not null)) as issue from st")
def validate_financials(t: Tables) -> DataFrame:
    s = statements(t).withColumn("k", F.struct("company", "year"))
    tight = ("warning", "net_margin_outside", F.abs(N.ratio("net_income", "revenue")) > 0.05)  # these margins are small
    return finance.issues(s, "k", [*finance.statement_rules()[:2], tight]).select("k.company", "k.year", N.key("severity", "rule").alias("issue"))


@query("select sha256(text) as digest, count(*) - 1 as extra from documents group by text having count(*) > 1")
def duplicate_texts(t: Tables) -> DataFrame:
    return finance.repeated_keys(t.documents.select(F.sha2(F.col("text").cast("binary"), 256).alias("digest")), "digest")


@query("""with n as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, max(n) as count, round(avg(value), 6) as mean, max(value) filter (i = n // 2) as p50, case when max(n) > 20 then max(value) filter (i = floor(n * 0.95)) else max(value) end as p95, case when max(n) > 100 then max(value) filter (i = floor(n * 0.99)) else max(value) end as p99, max(value) as max from n group by event_type""")
def latency_percentiles(t: Tables) -> DataFrame:
    return monitoring.nearest_rank(t.events, "event_type", "value")


@query("select cast(date_trunc('day', ts) as date) as day, round(avg(case when event_type <> 'error' then value end), 4) as avg_score, round(avg(case when event_type = 'error' then 1.0 else 0.0 end), 6) as error_rate, count(*) as n, count(distinct user_id) as n_users from events group by 1")
def quality_snapshot(t: Tables) -> DataFrame:
    rows = t.events.groupBy(F.to_date("ts").alias("day"))
    return rows.agg(F.round(F.avg(F.when(F.col("event_type") != "error", F.col("value"))), 4).alias("avg_score"), F.round(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("error_rate"), F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


@query("select event_type, cast(json_extract_string(props, '$.k') as bigint) % 10 as bucket, count(*) as n from events group by all")
def event_counts(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", (F.get_json_object("props", "$.k").cast("long") % 10).alias("bucket")).agg(F.count("*").alias("n"))


@query("""with d as (select event_type, date_part('day', ts) // 8 as week, avg(value) as v from events group by all), b as (select event_type, v as base from d where week = 0)
select event_type, week, round(case when base = 0 then abs(v) else abs(v - base) / abs(base) end, 6) as drift, round(case when base = 0 then abs(v) else abs(v - base) / abs(base) end, 6) > 0.1 as significant from d join b using (event_type)""")
def metric_drift(t: Tables) -> DataFrame:
    by = t.events.groupBy("event_type", F.floor(F.dayofmonth("ts") / 8).alias("week")).agg(F.avg("value").alias("v"))
    base = by.where("week = 0").select("event_type", F.col("v").alias("base"))
    rows = by.join(base, "event_type").withColumn("drift", F.round(monitoring.drift(F.col("v"), F.col("base")), 6))
    return rows.select("event_type", "week", "drift", (F.col("drift") > 0.1).alias("significant"))


@query("""with l as (from (select vec_id, embedding from embeddings order by vec_id desc limit 100)), r as (select *, row_number() over (order by vec_id) - 1 as i, count(*) over () as n from l),
x as (select i < n // 2 as g, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as dim from r), m as (select dim, avg(x) filter (g) as a, avg(x) filter (not g) as b from x group by dim)
select round(1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) as drift, round(1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) > 0.05 as significant from m""")
def sample_drift(t: Tables) -> DataFrame:
    """Of the last 100 samples, the first half against the second."""
    return monitoring.sample_drift(t.embeddings, "vec_id")


@query("""with x as (select vec_id % 2 = 0 as g, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as dim from embeddings), m as (select dim, avg(x) filter (g) as a, avg(x) filter (not g) as b from x group by dim)
select round(1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) as drift from m""")
def centroid_drift(t: Tables) -> DataFrame:
    return monitoring.centroid_drift(t.embeddings, F.col("vec_id") % 2 == 0)


@query("""with r as (select user_id % 7 as service, value as top1, value / 2 as top10, event_type = 'error' as empty, ['A', 'B', 'C'][event_id % 3 + 1] as tier, case when event_id % 2 = 0 then 'compare' else 'explain' end as intent from events)
select service, round(avg(top1), 6) as avg_top1_score, round(avg(top10), 6) as avg_top10_score, round(avg(empty::int), 6) as empty_result_rate, count(*) filter (tier = 'A') as "tier_A", count(*) filter (tier = 'B') as "tier_B", count(*) filter (tier = 'C') as "tier_C", count(*) filter (intent = 'compare') as intent_compare, count(*) filter (intent = 'explain') as intent_explain from r group by service""")
def retrieval_snapshot(t: Tables) -> DataFrame:
    """Scores, empty results, tiers and intents of a log of retrievals, here of events."""
    tier = F.element_at(F.array(*map(F.lit, "ABC")), (F.col("event_id") % 3 + 1).cast("int"))
    log = t.events.select((F.col("user_id") % 7).alias("service"), F.col("value").alias("top1"), (F.col("value") / 2).alias("top10"), (F.col("event_type") == "error").alias("empty"), tier.alias("tier"), F.when(F.col("event_id") % 2 == 0, "compare").otherwise("explain").alias("intent"))
    return monitoring.quality_snapshot(log, ["service"], ("A", "B", "C"), ("compare", "explain"))


@query("from (select event_type, event_id, value from events qualify row_number() over (partition by event_type order by ts desc, event_id desc) <= 1000)")
def sliding_last_n(t: Tables) -> DataFrame:
    return monitoring.last_n(t.events, ["event_type"], [F.desc("ts"), F.desc("event_id")]).select("event_type", "event_id", "value")


@query("""with old as (select p_type as k, min(p_brand) as label, min(p_size) as conf from part where p_partkey % 2 = 0 group by p_type), new as (select p_type as k, max(p_brand) as label, max(p_size) as conf from part where p_partkey % 3 = 0 group by p_type)
select coalesce(old.k, new.k) as k, coalesce(old.label, new.label) as label, coalesce(new.conf, old.conf) as conf from old full join new on old.k = new.k""")
def upsert_lexicon(t: Tables) -> DataFrame:
    """The label stays, the confidence is replaced."""
    old = t.part.where("p_partkey % 2 = 0").groupBy(F.col("p_type").alias("k")).agg(F.min("p_brand").alias("label"), F.min("p_size").alias("conf"))
    new = t.part.where("p_partkey % 3 = 0").groupBy(F.col("p_type").alias("k")).agg(F.max("p_brand").alias("label"), F.max("p_size").alias("conf"))
    return lexicon.upsert(old, new, "k", ["conf"])


@query("select p_name, min(p_partkey) as p_partkey from part group by p_name")
def insert_first_wins(t: Tables) -> DataFrame:
    return ranking.first_wins(t.part.select("p_name", "p_partkey"), ["p_name"], [F.asc("p_partkey")])


@query("select vec_id, label + case when vec_id % 5 = 0 then 100 else 0 end as label from embeddings where vec_id % 7 <> 0")
def vector_upsert_delete(t: Tables) -> DataFrame:
    old = t.embeddings.select("vec_id", F.col("label").cast("long").alias("label"))
    new = old.where("vec_id % 5 = 0").withColumn("label", F.col("label") + 100)
    return sinks.delete(sinks.upsert_vectors(old, new), old.where("vec_id % 7 = 0"))


@query("select distinct source as generation, case when source = (select max(source) from documents) then 'active' else 'deprecated' end as status from documents")
def generation_activate(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("source").alias("generation")).distinct()
    top = rows.agg(F.max("generation").alias("top"))
    return monitoring.activate(rows.crossJoin(F.broadcast(top)), "generation", F.col("top")).select("generation", "status")  # top: one row


@query("select lang, source, count(*) as n, sum(n_chars) as chars from documents group by rollup(lang, source)")
def facet_rollup(t: Tables) -> DataFrame:
    return t.documents.rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube(o_orderstatus, o_orderpriority)")
def facet_cube(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


def _timed(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("select time_bucket(interval 5 minutes, ts) as window_start, time_bucket(interval 5 minutes, ts) + interval 5 minutes as window_end, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def events_tumbling(t: Tables) -> DataFrame:
    return _timed(windows.tumbling(t.events), "window_start", "window_end")


@query("with w as (select unnest([time_bucket(interval 5 minutes, ts), time_bucket(interval 5 minutes, ts) - interval 5 minutes]) as s, event_type, value from events) select s as window_start, s + interval 10 minutes as window_end, event_type, count(*) as n, round(sum(value), 4) as total from w group by all")
def events_sliding(t: Tables) -> DataFrame:
    return _timed(windows.sliding(t.events), "window_start", "window_end")


@query("""with l as (select *, case when ts < lag(ts) over (partition by user_id order by ts) + interval 30 minutes then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts, event_id) as k from l)
select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end, count(*) as n from s group by user_id, k""")
def events_session(t: Tables) -> DataFrame:
    return _timed(windows.sessions(t.events), "session_start", "session_end")
