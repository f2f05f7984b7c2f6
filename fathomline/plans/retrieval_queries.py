"""Queries of lexical and vector retrieval, lexicon lookups, fusion and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import evaluation, fusion, lexical, lexicon, ranking, vector
from ..sources.scratch import settle
from . import retrieval
from .catalog import Tables, query
from .text_queries import TOKENS

SOURCE_BOOSTS = {"src0": 1.2, "src1": 1.3, "src2": 1.1, "src4": 1.1, "src5": 1.15}


def terms(t: Tables) -> DataFrame:
    """All distinct terms of the benchmark's items, taken as questions."""
    return lexical.query_terms(t.benchmark, "item_id", "text")


def _bm25_sql(docs: str = "documents", p: str = "") -> str:
    """CTEs up to ``scored``: query_id, doc_id, score, n_terms; ``asked``: query_id, term; their names behind ``p``."""
    return rf"""{p}tok as (select doc_id, {TOKENS} as w from {docs}), {p}len as (select doc_id, len(w) as dl from {p}tok), {p}n as (select count(*) as n, avg(dl) as mean from {p}len),
{p}asked as (select distinct item_id as query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_&/]+')) as term from benchmark),
{p}tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from {p}tok) where term in (select term from {p}asked) group by all),
{p}df as (select term, count(*) as df from {p}tf group by term),
{p}part as (select doc_id, term, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) as p from {p}tf join {p}df using (term) join {p}len using (doc_id), {p}n),
{p}scored as (select query_id, doc_id, round(sum(p), 6) as score, count(*) as n_terms from {p}part join {p}asked using (term) group by all)"""


_RANK = "row_number() over (partition by query_id order by score desc, doc_id)"


@query(f"with {_bm25_sql()} select query_id, doc_id, score, {_RANK} as rank from scored qualify {_RANK} <= 10")
def bm25_topk(t: Tables) -> DataFrame:
    return lexical.bm25_top(t.documents, terms(t), 10)


@query(f"with {_bm25_sql()}, m as (select query_id, count(*) as asked from asked group by 1), s as (select scored.* from scored join m using (query_id) where n_terms = asked) select query_id, doc_id, score, {_RANK} as rank from s qualify {_RANK} <= 10")
def fts_and_topk(t: Tables) -> DataFrame:
    return lexical.bm25_top(t.documents, terms(t), 10, mode="and")


@query(f"with en as (select * from documents where lang = 'en'), {_bm25_sql(docs='en')} select query_id, doc_id, score, {_RANK} as rank from scored qualify {_RANK} <= 10")
def bm25_filtered_lang(t: Tables) -> DataFrame:
    return lexical.bm25_top(t.documents.where("lang = 'en'"), terms(t), 10)


_BOOST = "case source " + " ".join(f"when '{s}' then {b}" for s, b in SOURCE_BOOSTS.items()) + " else 1.0 end"


@query(f"""with {_bm25_sql()}, top as (select query_id, doc_id, score from scored qualify {_RANK} <= 100),
b as (select query_id, doc_id, round(top.score * cast({_BOOST} as double), 6) as score from top join documents using (doc_id)) select query_id, doc_id, score, {_RANK} as rank from b qualify {_RANK} <= 10""")
def section_boost_topk(t: Tables) -> DataFrame:
    """The boost comes after the first cut."""
    top = lexical.bm25_top(t.documents, terms(t), 100).drop("rank").join(t.documents.select("doc_id", "source"), "doc_id")
    return lexical.best(lexical.boosted(top, "source", SOURCE_BOOSTS).drop("source"), 10)


_GRAMS = "list_distinct(list_transform(range(1, length('  ' || lower({0}) || ' ') - 1), lambda i: substr('  ' || lower({0}) || ' ', i, 3)))"


def _sim_sql(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))::double / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"


@query(f"""with p as (select distinct p_name as x, {_GRAMS.format('p_name')} as g from part) select a.x as a, b.x as b, round({_sim_sql('a.g', 'b.g')}, 6) as sim from p a, p b where a.x < b.x and round({_sim_sql('a.g', 'b.g')}, 6) >= 0.3""")
def trigram_similarity_join(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_name").alias("a"))
    return lexical.trigram_pairs(names, names.withColumnRenamed("a", "b"), "a", "b", 0.3).where("a < b")


@query(f"""with q as (select p_partkey, p_name, {_GRAMS.format('p_name')} as g from part where p_partkey % 100 = 0), c as (select distinct p_type, {_GRAMS.format('p_type')} as g from part),
s as (select p_partkey, p_type, round({_sim_sql('q.g', 'c.g')}, 6) as sim from q, c) select p_partkey, p_type, sim, row_number() over (partition by p_partkey order by sim desc, p_type) as rank from s where sim >= 0.1 qualify row_number() over (partition by p_partkey order by sim desc, p_type) <= 20""")
def trigram_search(t: Tables) -> DataFrame:
    asked = t.part.where("p_partkey % 100 = 0").select("p_partkey", "p_name")
    near = lexical.trigram_pairs(asked, t.part.select("p_type"), "p_name", "p_type", 0.1)
    return ranking.top_k(asked.join(near, "p_name"), ["p_partkey"], [F.desc("sim"), F.asc("p_type")], 20).select("p_partkey", "p_type", "sim", "rank")


# A lexicon out of the tables: nations as tickers, brands and types of parts as entries and concepts.
def tickers(t: Tables) -> DataFrame:
    return t.nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("canonical_id"), F.upper(F.substring("n_name", 1, 3)).alias("ticker"), F.array("n_name", F.concat("n_name", F.lit(" Inc"))).alias("variants"), F.col("n_name").alias("company_name"), F.col("n_nationkey").alias("seq"))


def entries(t: Tables) -> DataFrame:
    return t.part.groupBy("p_type").agg(F.min("p_brand").alias("brand"), F.min("p_partkey").alias("k")).select(F.concat(F.lit("v1:"), "brand", F.lit(":"), "p_type").alias("entry_id"), F.col("p_type").alias("surface_form"), F.col("brand").alias("canonical_id"), F.col("brand").alias("canonical_label"), F.lit("metric_alias").alias("entry_type"), (0.5 + (F.col("k") % 5) / 10).alias("confidence"))


def mentions(t: Tables) -> DataFrame:
    """Nations cut short, types of parts, words of part names, market segments and priorities."""
    parts = [
        t.nation.select(F.upper(F.substring("n_name", 1, 3)).alias("mention")),
        t.nation.select(F.expr("substring(n_name, 1, length(n_name) - 1)").alias("mention")),
        t.part.select(F.lower("p_type").alias("mention")),
        t.part.select(F.explode(F.split("p_name", " ")).alias("mention")),
        t.customer.select(F.col("c_mktsegment").alias("mention")),
        t.orders.select(F.col("o_orderpriority").alias("mention")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


_LEXICON = f"""tick as (select 'nation:' || n_nationkey as canonical_id, n_name as label, n_nationkey as seq, upper(unnest([upper(substr(n_name, 1, 3)), n_name, n_name || ' Inc'])) as form from nation),
ent as (select 'v1:' || min(p_brand) || ':' || p_type as entry_id, p_type as surface_form, min(p_brand) as canonical_id, min(p_brand) as label, 0.5 + (min(p_partkey) % 5) / 10.0 as confidence from part group by p_type),
men as (select distinct trim(mention) as mention from (select upper(substr(n_name, 1, 3)) as mention from nation union all select substr(n_name, 1, length(n_name) - 1) from nation union all select lower(p_type) from part union all select unnest(string_split(p_name, ' ')) from part union all select c_mktsegment from customer union all select o_orderpriority from orders) where trim(mention) <> ''),
r1 as (select mention, canonical_id, label, 'ticker' as entry_type, 'exact_ticker' as method, 1.0::double as confidence, 1.0::double as sim from men join tick on upper(mention) = form qualify row_number() over (partition by mention order by seq) = 1),
r2 as (select mention, canonical_id, label, 'metric_alias', 'exact_alias', confidence::double, 1.0::double from men join ent on lower(mention) = lower(surface_form) where mention not in (select mention from r1) qualify row_number() over (partition by mention order by confidence desc, entry_id) = 1),
l3 as (select mention, {_GRAMS.format('mention')} as g from men where mention not in (select mention from r1) and mention not in (select mention from r2)),
f3 as (select *, {_GRAMS.format('form')} as fg from tick),
s3 as (select mention, canonical_id, label, seq, form, round({_sim_sql('g', 'fg')}, 6) as sim from l3, f3),
r3 as (select mention, canonical_id, label, 'ticker', 'trigram_ticker', sim as confidence, sim from s3 where sim >= 0.3 qualify row_number() over (partition by mention order by sim desc, seq, form) = 1),
f4 as (select *, {_GRAMS.format('surface_form')} as fg from ent),
s4 as (select mention, canonical_id, label, entry_id, confidence, round({_sim_sql('g', 'fg')}, 6) as sim from l3, f4 where mention not in (select mention from r3)),
r4 as (select mention, canonical_id, label, 'metric_alias', 'trigram_alias', round(cast(sim * confidence as double), 6), sim from s4 where sim >= 0.3 qualify row_number() over (partition by mention order by sim desc, entry_id) = 1),
res as (from r1 union all from r2 union all from r3 union all from r4)"""


@query(f"with {_LEXICON} select mention, canonical_id, label, entry_type, method, round(confidence, 6) as confidence, sim, case when entry_type = 'ticker' then 'company' else 'metric' end as role from res")
def fuzzy_resolve(t: Tables) -> DataFrame:
    return lexicon.routed(lexicon.resolve(mentions(t), entries(t), tickers(t))).withColumn("confidence", F.round("confidence", 6))


@query(f"with {_LEXICON} select mention from men where mention not in (select mention from res)")
def unresolved_terms(t: Tables) -> DataFrame:
    return lexicon.unresolved(mentions(t), lexicon.resolve(mentions(t), entries(t), tickers(t)))


@query(f"""with ent as (select p_type as surface_form, min(p_brand) as concept, 0.5 + (min(p_partkey) % 5) / 10.0 as confidence from part group by p_type), term as (select distinct trim(x) as term from (select unnest(string_split(p_name, ' ')) as x from part union all select lower(p_type) from part union all select p_name from part) where trim(x) <> ''),
e as (select term, concept, confidence::double as confidence, 'exact' as method from term join ent on lower(term) = lower(surface_form) qualify row_number() over (partition by term order by confidence desc, concept) = 1),
l as (select term, {_GRAMS.format('term')} as g from term where term not in (select term from e)), f as (select *, {_GRAMS.format('surface_form')} as fg from ent), s as (select term, concept, round({_sim_sql('g', 'fg')}, 6) as sim from l, f),
z as (select term, concept, sim as confidence, 'fuzzy' as method from s where sim >= 0.4 qualify row_number() over (partition by term order by sim desc, concept) = 1)
select term, concept, method, round(confidence, 6) as confidence from (from e union all from z)""")
def schema_link(t: Tables) -> DataFrame:
    mapped = entries(t).select("surface_form", F.col("canonical_id").alias("concept"), F.lit("custom").alias("taxonomy"), F.col("canonical_label").alias("label"), "confidence")
    asked = t.part.select(F.explode(F.concat(F.split("p_name", " "), F.array(F.lower("p_type"), F.col("p_name")))).alias("term"))
    return lexicon.link_schema(asked, mapped).select("term", "concept", "method", F.round("confidence", 6).alias("confidence"))


@query("with ent as (select p_type as s, min(p_brand) as c from part group by p_type) select a.s as word, b.s as synonym from ent a join ent b on a.c = b.c where lower(a.s) <> lower(b.s)")
def synonym_expand(t: Tables) -> DataFrame:
    e = entries(t)
    return lexicon.synonyms(e.select(F.col("surface_form").alias("word")), e)


@query(f"""with {_LEXICON}, o as (select o_orderkey, o_orderpriority, c_mktsegment, upper(substr(n_name, 1, 3)) as tick from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)
select o_orderkey, tick || ' ' || r.label || ' ' || c_mktsegment as expanded, r.canonical_id as company_id from o join res r on r.mention = tick""")
def expand_query(t: Tables) -> DataFrame:
    """Identifiers of order questions resolved, their labels put beside them, the company as a filter."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("tick", F.upper(F.substring("n_name", 1, 3)))
    found = lexicon.resolve(rows.select(F.col("tick").alias("mention")), entries(t), tickers(t))
    return rows.join(found, rows["tick"] == found["mention"]).select("o_orderkey", F.concat_ws(" ", "tick", "label", "c_mktsegment").alias("expanded"), F.col("canonical_id").alias("company_id"))


@query("select p_brand || ':' || p_type as term, p_brand as concept, 'custom' as taxonomy, count(*) as n from part group by all union all select array_to_string(list_reverse(string_split(lower(p_name || ', ' || p_brand), ', ')), ' '), 'part:' || p_brand, 'part', count(*) from part group by all union all select lower(p_name || ', ' || p_brand), 'part:' || p_brand, 'part', count(*) from part group by all")
def concept_taxonomy(t: Tables) -> DataFrame:
    """Labels with a comma are entered twice, once turned round; a prefix before a colon is the taxonomy."""
    plain = t.part.select(F.concat_ws(":", "p_brand", "p_type").alias("term"), F.col("p_brand").alias("concept"), F.lit("custom").alias("taxonomy"))
    turned = lexicon.taxonomy(t.part.select(F.concat(F.lit("part:"), "p_brand").alias("name"), F.concat_ws(", ", "p_name", "p_brand").alias("label")))
    return plain.unionByName(turned).groupBy("term", "concept", "taxonomy").agg(F.count("*").alias("n"))


_Q = "q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 100 = 0)"


def _knn_sql(score: str, k: int = 10, where: str = "true") -> str:
    return f"s as (select query_id, vec_id, round({score}, 6) as score from q, embeddings where vec_id <> query_id and {where}), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= {k})"


_COS, _DOT, _EUC = "list_cosine_similarity(q, embedding::double[])", "list_inner_product(q, embedding::double[])", "-list_distance(q, embedding::double[])"


def _asked(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 100 = 0")


@query(f"with {_Q}, {_knn_sql(_COS)} from r")
def knn_cosine(t: Tables) -> DataFrame:
    return vector.nearest(t.embeddings, _asked(t), 10)


@query(f"with {_Q}, {_knn_sql(_DOT)} from r")
def knn_dot(t: Tables) -> DataFrame:
    return vector.nearest(t.embeddings, _asked(t), 10, "dot")


@query(f"with {_Q}, {_knn_sql(_EUC)} from r")
def knn_euclid(t: Tables) -> DataFrame:
    return vector.nearest(t.embeddings, _asked(t), 10, "euclid")


@query(f"with {_Q}, {_knn_sql(_COS, where='label in (1, 2, 3) and vec_id between 50 and 1000000')} from r")
def knn_filtered(t: Tables) -> DataFrame:
    kept = t.embeddings.where(vector.payload_filter(within={"label": [1, 2, 3]}, between={"vec_id": (50, 1_000_000)}))
    return vector.nearest(kept, _asked(t), 10)


@query("with x as (select vec_id, label, embedding::double[] as v, (embedding::double[])[1:16] as s from embeddings) select label, count(*) as n, round(avg(sqrt(list_inner_product(v, v))), 6) as full_norm, round(avg(sqrt(list_inner_product(s, s))), 6) as short_norm, round(avg(list_inner_product(list_transform(s, lambda c: c / sqrt(list_inner_product(s, s))), list_transform(s, lambda c: c / sqrt(list_inner_product(s, s))))), 6) as truncated_norm from x group by label")
def mrl_truncate(t: Tables) -> DataFrame:
    rows = t.embeddings.select("label", V.norm("embedding").alias("f"), V.norm(F.slice("embedding", 1, 16)).alias("s"), V.truncated("embedding", 16).alias("t"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("f"), 6).alias("full_norm"), F.round(F.avg("s"), 6).alias("short_norm"), F.round(F.avg(V.norm("t")), 6).alias("truncated_norm"))


_SHORT = "list_cosine_similarity(q[1:16], (embedding::double[])[1:16])"


@query(f"with {_Q}, {_knn_sql(_COS)}, s2 as (select query_id, vec_id, round({_SHORT}, 6) as score from q, embeddings where vec_id <> query_id), r2 as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s2 qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10) select 'narrative' as channel, * from r union all select 'entity_schema', * from r2")
def dual_channel(t: Tables) -> DataFrame:
    short = t.embeddings.withColumn("embedding", V.truncated("embedding", 16))
    return knn_cosine(t).withColumn("channel", F.lit("narrative")).unionByName(vector.nearest(short, short.where("vec_id % 100 = 0"), 10).withColumn("channel", F.lit("entity_schema")))


def _channels(t: Tables) -> DataFrame:
    """BM25 and vector hits of the benchmark items; vec_id stands for doc_id, and an item's vector is the one of its number."""
    lex = lexical.bm25_top(t.documents, terms(t), 100).withColumnRenamed("doc_id", "item")
    asked = t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    vec = vector.nearest(t.embeddings, asked, 100).withColumnRenamed("vec_id", "item")
    return settle(fusion.channel(lex, "lexical", "item", "score", 100).unionByName(fusion.channel(vec, "narrative", "item", "score", 100)), "channels")


_CHANNELS = f"""{_bm25_sql()}, lex as (select query_id, 'lexical' as channel, doc_id as item, score, {_RANK} as rank from scored qualify {_RANK} <= 100),
vq as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id in (select item_id from benchmark)), vs as (select query_id, vec_id as item, round({_COS}, 6) as score from vq, embeddings where vec_id <> query_id),
vec as (select query_id, 'narrative' as channel, item, score, row_number() over (partition by query_id order by score desc, item) as rank from vs qualify row_number() over (partition by query_id order by score desc, item) <= 100),
hits as (from lex union all from vec)"""
_TOP = "row_number() over (partition by query_id order by fused desc, item)"
_RRF = f"{_CHANNELS}, f as (select query_id, item, round(sum(1 / (60.0::double + rank)), 6) as fused, count(*) as channels from hits group by all), fused as (select *, {_TOP} as rank from f)"


@query(f"with {_RRF} from fused where rank <= 20")
def rrf_fusion(t: Tables) -> DataFrame:
    return fusion.final_hits(fusion.reciprocal_ranks(_channels(t)), 20)


@query(f"""with {_CHANNELS}, e as (select query_id, channel, min(score) as lo, max(score) as hi from hits group by all),
f as (select query_id, item, round(sum(case channel when 'lexical' then 0.4::double else 0.36::double end * (score - lo) / case when hi > lo then hi - lo else 1.0 end), 6) as fused, count(*) as channels from hits join e using (query_id, channel) group by all)
select *, {_TOP} as rank from f qualify {_TOP} <= 20""")
def weighted_blend(t: Tables) -> DataFrame:
    return fusion.final_hits(fusion.weighted_blend(_channels(t)), 20)


@query(f"""with {_RRF}, s as (select query_id, item, max(score) filter (channel = 'lexical') as l, max(score) filter (channel = 'narrative') as v from hits group by all)
select query_id, item, rank, 'Scores: ' || concat_ws(', ', case when l > 0 then printf('BM25=%.3f', round(l, 3)) end, case when v > 0 then printf('dense=%.3f', round(v, 3)) end, case when fused > 0 then printf('fused=%.3f', round(fused, 3)) end) || printf(' | Final=%.4f (rank #%d)', round(fused, 4), rank) as explanation from fused join s using (query_id, item) where rank <= 10""")
def fused_explain(t: Tables) -> DataFrame:
    hits = _channels(t)
    by = lambda n: F.max(F.when(F.col("channel") == n, F.col("score")))
    scores = hits.groupBy("query_id", "item").agg(by("lexical").alias("l"), by("narrative").alias("v"))
    rows = fusion.final_hits(fusion.reciprocal_ranks(hits), 10).join(scores, ["query_id", "item"])
    return rows.select("query_id", "item", "rank", fusion.explanation(F.coalesce("l", F.lit(0.0)), F.coalesce("v", F.lit(0.0)), F.col("fused"), F.col("rank")).alias("explanation"))


def _item_terms(t: Tables, fused: DataFrame) -> DataFrame:
    return lexical.item_terms(t.documents, fused.where(F.col("rank") <= fusion.RERANK_TOP), terms(t))


_RERANK = """kept as (from fused where rank <= 50), met as (select query_id, item, count(*) as n from kept join asked using (query_id) join (select distinct doc_id as item, term from tf) using (item, term) group by all),
m as (select query_id, count(*) as asked_n from asked group by 1), rr as (select query_id, item, rank as old_rank, round(coalesce(n, 0)::double / asked_n, 6) as rerank_score from kept left join met using (query_id, item) join m using (query_id)),
again as (select *, row_number() over (partition by query_id order by rerank_score desc, old_rank) as rank from rr)"""


@query(f"with {_RRF}, {_RERANK} from again")
def overlap_rerank(t: Tables) -> DataFrame:
    fused = fusion.reciprocal_ranks(_channels(t))
    return fusion.overlap_rerank(fused, terms(t), _item_terms(t, fused))


@query(f"with {_RRF}, {_RERANK} select query_id, item, rank, case when query_id % 3 = 0 then 'A' else 'B' end as tier from (select query_id, item, rank from fused where query_id % 3 = 0 union all select query_id, item, rank from again where query_id % 3 <> 0) where rank <= 20")
def hybrid_tiered(t: Tables) -> DataFrame:
    tiers = t.benchmark.select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 3 == 0, "A").otherwise("B").alias("tier"))
    fused = fusion.reciprocal_ranks(_channels(t))
    return retrieval.tiered(fused, tiers, terms(t), _item_terms(t, fused), 20)


# Judgments are pooled: the first 50 documents of each query, graded by their labels. The run to judge is another ranking.
def _run_and_qrels(t: Tables) -> tuple[DataFrame, DataFrame]:
    pool = lexical.bm25_top(t.documents, terms(t), 50).join(t.labels, "doc_id")
    qrels = pool.select("query_id", F.col("doc_id").alias("item"), (F.col("quality") * (2 - F.col("toxic"))).cast("int").alias("rel"))
    run = lexical.bm25_top(t.documents.where("lang = 'en'"), terms(t), 100).select("query_id", F.col("doc_id").alias("item"), "rank")
    return run, qrels


#: The run to judge ranks the English documents alone, by their own frequencies and lengths.
_EN = f"en as (select * from documents where lang = 'en'), {_bm25_sql('en', 'en_')},"
_JUDGED = f"""{_bm25_sql()}, qrels as (select query_id, doc_id as item, cast(quality * (2 - toxic) as integer) as rel from (select query_id, doc_id from scored qualify {_RANK} <= 50) join labels using (doc_id)),
{_EN} run as (select query_id, doc_id as item, {_RANK} as rank from en_scored qualify {_RANK} <= 100),
j as (select query_id, item, rank, coalesce(rel, 0) as rel from run left join qrels using (query_id, item)), nr as (select query_id, count(*) as n_rel from qrels where rel > 0 group by 1), ks as (select unnest([1, 3, 5, 10, 20, 50, 100])::bigint as k)"""


@query(f"with {_JUDGED}, h as (select query_id, k, count(*) filter (rel > 0 and rank <= k) as hits from j, ks group by all) select query_id, k, round(hits / k, 6) as precision, round(coalesce(hits / n_rel, 0), 6) as recall from h left join nr using (query_id)")
def ir_precision_recall(t: Tables) -> DataFrame:
    return evaluation.precision_recall(*_run_and_qrels(t))


@query(f"""with {_JUDGED}, d as (select query_id, k, sum(case when rank <= k then (pow(2.0, rel) - 1) / log2(rank + 1) else 0 end) as d from j, ks group by all), ir as (select query_id, rel, row_number() over (partition by query_id order by rel desc, item) as rank from qrels),
i as (select query_id, k, sum(case when rank <= k then (pow(2.0, rel) - 1) / log2(rank + 1) else 0 end) as i from ir, ks group by all) select query_id, k, round(coalesce(case when i > 0 then d / i end, 0), 6) as ndcg from d left join i using (query_id, k)""")
def ir_ndcg(t: Tables) -> DataFrame:
    return evaluation.ndcg(*_run_and_qrels(t))


_AP = "c as (select *, sum(case when rel > 0 then 1 else 0 end) over (partition by query_id order by rank) as hits from j), ap as (select query_id, round(coalesce(sum(case when rel > 0 then hits / rank else 0.0 end) / max(n_rel), 0), 6) as ap, round(coalesce(1.0::double / min(case when rel > 0 then rank end), 0), 6) as rr from c left join nr using (query_id) group by query_id)"


@query(f"with {_JUDGED}, {_AP} from ap")
def ir_map_mrr(t: Tables) -> DataFrame:
    return evaluation.average_precision(*_run_and_qrels(t))


@query(f"with {_JUDGED}, {_AP}, a as (select coalesce(ap, 0) as ap, coalesce(rr, 0) as rr from benchmark left join ap on query_id = item_id) select count(*) as n_queries, round(avg(ap), 6) as map, round(avg(rr), 6) as mrr from a")
def ir_summary(t: Tables) -> DataFrame:
    """Macro averages over all queries; those without a hit count as 0."""
    found = t.benchmark.select(F.col("item_id").alias("query_id")).join(ir_map_mrr(t), "query_id", "left").na.fill(0.0, ["ap", "rr"])
    return found.agg(F.count("*").alias("n_queries"), F.round(F.avg("ap"), 6).alias("map"), F.round(F.avg("rr"), 6).alias("mrr"))


@query("""with r as (select event_type as method, value as latency, round((user_id % 100) / 100.0::double, 6) as recall, round((event_id % 50) / 50.0::double, 6) as ndcg, round(1.0::double / (1 + event_id % 10), 6) as rr from events)
select method, count(*) as n_queries, round(avg(recall), 6) as avg_recall, round(avg(ndcg), 6) as avg_ndcg, round(avg(rr), 6) as avg_rr, round(avg(latency), 6) as avg_latency, round(quantile_cont(latency, 0.95), 6) as p95_latency from r group by method""")
def eval_method_summary(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_type").alias("method"), F.col("value").alias("latency"), F.round((F.col("user_id") % 100) / 100, 6).alias("recall"), F.round((F.col("event_id") % 50) / 50, 6).alias("ndcg"), F.round(1 / (1 + F.col("event_id") % 10), 6).alias("rr"))
    return evaluation.summary(rows)
