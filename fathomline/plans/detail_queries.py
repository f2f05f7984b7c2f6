"""Queries of the finer points: fields by type, issues, payloads, previews, literals, two vectors, a seed lexicon, whole answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions import tokens
from ..operators import chunking, dual, fusion, graph, graph_build, lexical, lexicon, vector, versioning
from ..sources import readers
from ..sources.scratch import lookup
from . import expansion, retrieval
from .catalog import Tables, query
from .graph_queries import edges
from .retrieval_queries import _CHANNELS, _RANK, _RRF, _TOP, _bm25_sql, _channels, entries, terms
from .text_queries import _QUESTIONS, questions

#: A text with marks, composed and control characters, so that all rules meet each document.
_MARKED = "concat(chr(7), text, chr(8211), chr(8203), chr(127), chr(9), 'end', chr(1))"


@query(rf"""with m as (select doc_id, lang, concat(chr(7), text, chr(8211), chr(8203), chr(127), chr(9), 'end', chr(1)) as x from documents where text is not null),
a as (select *, replace(translate(x, chr(8211) || chr(8212) || chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(160) || chr(8203) || chr(8206) || chr(8207) || chr(65279), '--''''"" '), chr(8230), '...') as y from m),
b as (select *, regexp_extract_all(y, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}\x{{ad}}]') as bad, regexp_replace(regexp_replace(regexp_replace(regexp_replace(y, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}\x{{ad}}]', '', 'g'), '[ \t\r\f\x0b]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as z from a)
select doc_id, coalesce(nullif(lang, ''), 'en') as language, md5(x) as original, md5(z) as normalized, len(bad) as n_issues, array_to_string(list_transform(bad, lambda c: printf('removed control char U+%04X', unicode(c))), '; ') as issues from b""")
def normalization_report(t: Tables) -> DataFrame:
    """Each text as it was, its normal form, its language and what was removed."""
    rows = t.documents.where("text is not null").select("doc_id", "lang", F.expr(_MARKED.replace("chr(8211)", "decode(unhex('E28093'), 'UTF-8')").replace("chr(8203)", "decode(unhex('E2808B'), 'UTF-8')")).alias("x"))
    rows = rows.select("doc_id", T.normalization("x", "lang").alias("r"))
    return rows.select("doc_id", "r.language", F.md5("r.original").alias("original"), F.md5("r.normalized").alias("normalized"), F.size("r.issues").cast("long").alias("n_issues"), F.array_join("r.issues", "; ").alias("issues"))


@query(r"""with f as (select p_partkey, case p_partkey % 2 when 0 then 'schema' else 'identifier' end as field, case p_partkey % 2 when 0 then lower(trim(p_type || ':' || p_brand)) else p_type || ' ' || p_brand end as x, case p_partkey % 2 when 0 then '[:/\-_\s]+' else '\s' end as cut from part),
w as (select p_partkey, field, string_split_regex(x, cut) as w from f), s as (select p_partkey, field, unnest(w) as token, unnest(list_transform(range(1, len(w) + 1), lambda i: coalesce(list_sum(list_transform(w[1:i - 1], lambda y: length(y) + 1)), 0)))::bigint as start from w)
select p_partkey, field as kind, token, start, start + length(token) as "end", case field when 'identifier' then upper(token) else token end as normalized from s where token <> ''""")
def field_tokens(t: Tables) -> DataFrame:
    """One column of fields of two types, each row's tokens by its own type."""
    even = F.col("p_partkey") % 2 == 0
    rows = t.part.select("p_partkey", F.when(even, "schema").otherwise("identifier").alias("field"), F.when(even, F.concat_ws(":", "p_type", "p_brand")).otherwise(F.concat_ws(" ", "p_type", "p_brand")).alias("x"))
    found = rows.select("p_partkey", F.explode(tokens.typed_tokens("x", F.col("field"))).alias("k"))
    return found.select("p_partkey", "k.kind", F.col("k.text").alias("token"), "k.start", "k.end", "k.normalized")


@query(rf"""with {_CHANNELS}, p as (select query_id, item, channel, case channel when 'lexical' then 3 else 1 + cast(item % 3 = 0 as integer) * 2 end as size from hits),
b as (select query_id, item, channel, size from p qualify row_number() over (partition by query_id, item order by size desc, channel) = 1)
select query_id, item, size::bigint as n_fields, case when channel = 'lexical' then source else 'vector' end as source from b left join documents on item = doc_id""")
def fused_payload(t: Tables) -> DataFrame:
    """Of what the channels know of a hit, the fullest: documents' fields, or the vector's."""
    doc = t.documents.select(F.col("doc_id").alias("item"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.length("text").cast("string").alias("size"))
    of = lambda *pairs: F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs]))
    full = of(("source", F.col("source")), ("lang", F.col("lang")), ("size", F.col("size")))
    short, long = of(("source", F.lit("vector"))), of(("source", F.lit("vector")), ("a", F.lit("1")), ("b", F.lit("2")))
    hits = _channels(t).join(doc, "item", "left")
    hits = hits.withColumn("payload", F.when(F.col("channel") == "lexical", full).when(F.col("item") % 3 == 0, long).otherwise(short))
    return fusion.fullest(hits).select("query_id", "item", F.size("payload").cast("long").alias("n_fields"), F.col("payload")["source"].alias("source"))


@query(f"""with {_RRF} select query_id, item, fused.rank, fused.fused as final_score, coalesce(substr(text, 1, 200), '') as preview from fused left join documents on item = doc_id where fused.rank <= 10""")
def explained_hits(t: Tables) -> DataFrame:
    """The ten best of each question with their score and the start of their text."""
    rows = fusion.reciprocal_ranks(_channels(t)).select("query_id", "item", "rank", F.col("fused").alias("final_score"))
    return fusion.explained(rows, t.documents.select(F.col("doc_id").alias("item"), "text"))


@query("""with l as (select 'region:' || n_regionkey as label, 'customer:' || c_custkey as node from customer join nation on c_nationkey = n_nationkey),
s as (select label, count(*) as n_nodes, array_to_string(list_sort(list(node))[1:10], ',') as f from l group by label), r as (select *, row_number() over (order by n_nodes desc, label) - 1 as i from s)
select label, substr(sha256('entity:' || i || ':' || f), 1, 16) as community_id, n_nodes from r""")
def community_ids(t: Tables) -> DataFrame:
    """Customers by region as communities, with stable ids."""
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return graph.community_ids(rows.select(N.key(F.lit("region"), "n_regionkey").alias("label"), N.key(F.lit("customer"), "c_custkey").alias("node")), "entity")


@query("""with d as (select * from documents where doc_id is not null) select doc_id::varchar as subject, 'wasGeneratedBy' as predicate, 'run:' || lang as object from d where lang is not null
union all select doc_id || ':chunk:0', 'wasDerivedFrom', doc_id::varchar from d union all select doc_id::varchar, 'wasAttributedTo', 'agent:' || source from d where coalesce(source, '') <> ''""")
def provenance_triples(t: Tables) -> DataFrame:
    """What each document was generated by, what was derived from it, and whom it is attributed to."""
    docs = t.documents.where("doc_id is not null").select("doc_id", F.lit("").alias("title"), F.concat(F.lit("run:"), "lang").alias("run"), "source", F.length("text").alias("size"))
    chunks = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(":chunk:0")).alias("chunk_id"), "doc_id", F.lit(0).alias("start"), F.col("size").alias("end"))
    return graph_build.triples(graph_build.provenance(docs, chunks, agent="source")[1])


@query("""with l as (select l_orderkey, l_linenumber, l_partkey, l_returnflag from lineitem) select l_orderkey, form, l_linenumber::varchar as line, l_partkey::varchar as part, case form when 'csv' then l_returnflag || ',"' || chr(10) || 'x' else l_returnflag end as flag from l, (values ('json'), ('csv')) f(form)""")
def parsed_literals(t: Tables) -> DataFrame:
    """The lines of each order put into a literal, JSON and CSV with quotes and line ends in fields, and read back."""
    flag = F.col("l_returnflag")
    line = F.to_json(F.struct(F.col("l_linenumber").cast("string").alias("line"), F.col("l_partkey").cast("string").alias("part"), flag.alias("flag")))
    cell = F.concat_ws(",", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.concat(F.lit('"'), flag, F.lit(',""\nx"')))
    text = t.lineitem.groupBy("l_orderkey").agg(  # an order has a few lines
        F.concat(F.lit("["), F.array_join(F.collect_list(line), ","), F.lit("]")).alias("json"),
        F.concat(F.lit("line,part,flag\n"), F.array_join(F.collect_list(cell), "\n")).alias("csv"),
    )
    columns = ["line", "part", "flag"]
    of = lambda form, rows: text.select("l_orderkey", F.lit(form).alias("form"), F.inline(rows))
    return of("json", readers.parse_json(F.col("json"), "line string, part string, flag string")).unionByName(of("csv", readers.parse_csv(F.col("csv"), columns)))


@query(f"with en as (select * from documents where lang = 'en' and source = 'src1'), {_bm25_sql(docs='en')} select query_id, doc_id, score, {_RANK} as rank from scored qualify {_RANK} <= 10")
def bm25_filtered_all(t: Tables) -> DataFrame:
    """Language and source as one conjunction, before the scoring."""
    return lexical.bm25_top(lexical.matching(t.documents, lang="en", source="src1", doc_id=None), terms(t), 10)


@query()
def dual_chunk_vectors(t: Tables) -> DataFrame:
    """Both vectors of each chunk with their models; tests hold them against counts by hand."""
    chunks = chunking.chunks(t.documents).join(t.documents.select("doc_id", "source", "lang"), "doc_id")
    return dual.dual_vectors(chunks, ["source", "lang"], entity=dual.Model("local", "hashed-words", 64, dims=32))


@query("""select * from (values ('narrative', 'local:hashed-words', 64, substr(sha256('local:hashed-words:64'), 1, 12)), ('entity_schema', 'local:hashed-short', 32, substr(sha256('local:hashed-short:32'), 1, 12))) m(channel, model_id, dimensions, hash)
cross join (select count(*) as n_vectors from embeddings where embedding is not null) n""")
def dual_model_versions(t: Tables) -> DataFrame:
    """The models of both channels as the registry holds them, with the number of vectors they stand for."""
    models = dual.model_versions(t.spark, entity=dual.Model("local", "hashed-short", 64, dims=32))
    n = t.embeddings.where("embedding is not null").agg(F.count("*").alias("n_vectors"))  # one row
    return versioning.registered(models).crossJoin(F.broadcast(n)).select("channel", "model_id", "dimensions", "hash", "n_vectors")


def _seed_sql() -> str:
    import json
    from pathlib import Path

    made = json.loads((Path(readers.__file__).parent / "seed_lexicon.json").read_text())
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quoted(a['abbreviation'])}, {quoted(a['expansion'])}, {quoted(a['metric_id'])})" for a in made["abbreviations"])


@query(rf"""with {_QUESTIONS}, seed as (select * from (values {_seed_sql()}) s(abbreviation, expansion, metric_id)), w as (select distinct question_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_&/]+')) as token from q)
select question_id, token, expansion, metric_id from w join seed on upper(token) = abbreviation""")
def seed_expansions(t: Tables) -> DataFrame:
    """What the library's own lexicon says of the abbreviations in all questions; each distinct word is asked once."""
    rows = questions(t).select("question_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0)))).alias("token"))
    known = lexicon.expand_abbreviations(rows.select("token"), readers.seed_lexicon(t.spark)["abbreviations"])
    return rows.join(lookup(known, "known"), "token").select("question_id", "token", "expansion", "metric_id")


def company_questions(t: Tables) -> DataFrame:
    """``query_id``, ``text``: the benchmark's items as questions of three kinds, each about a nation by its sign."""
    signs = F.array(*[F.lit(a) for a in T.ABBREVIATIONS[:25]])
    kind = F.element_at(F.array(F.lit("Why "), F.lit("Compare "), F.lit("")), (F.col("item_id") % 3 + 1).cast("int"))
    sign = F.element_at(signs, (F.col("item_id") % 25 + 1).cast("int"))
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.concat(kind, F.when(F.col("item_id") % 4 > 0, F.concat(sign, F.lit(" "))).otherwise(""), F.coalesce("text", F.lit(""))).alias("text"))


def answer_inputs(t: Tables) -> dict:
    """All that retrieval.answer() takes: nations stand for companies, each with the documents of its number."""
    signs = F.array(*[F.lit(a) for a in T.ABBREVIATIONS[:25]])
    company = F.concat(F.lit("industry:"), F.col("n_nationkey").cast("string"))
    tickers = t.nation.select(F.element_at(signs, (F.col("n_nationkey") + 1).cast("int")).alias("ticker"), company.alias("canonical_id"), F.col("n_name").alias("company_name"), F.array("n_name").alias("variants"), F.col("n_nationkey").alias("seq"))
    e, short = entries(t), readers.seed_lexicon(t.spark)["abbreviations"]
    mapped = e.select("surface_form", F.col("canonical_id").alias("concept"), F.lit("custom").alias("taxonomy"), F.col("canonical_label").alias("label"), "confidence")
    asked = company_questions(t)
    embed = lambda df, i: df.select(F.col(i), vector.hashed_embedding(T.tokens("text")).alias("embedding"))
    return {
        "questions": asked,
        "docs": t.documents,
        "vectors": embed(t.documents, "doc_id").withColumnRenamed("doc_id", "item"),
        "query_vectors": embed(asked, "query_id"),
        "expansions": expansion.expanded(asked, e, tickers, short, mapped),
        "owners": t.documents.select(F.col("doc_id").alias("item"), F.concat(F.lit("industry:"), (F.col("doc_id") % 25).cast("string")).alias("company_id")),
        "edges": edges(t),
        "sections": t.documents.select(F.col("doc_id").alias("item"), F.col("source").alias("section")),
        "boosts": {"src1": 1.3, "src2": 1.2, "src3": 0.8},
    }


@query()
def answer_companies(t: Tables) -> DataFrame:
    """The whole way with expansions, companies' documents, section boosts and the graph; the test holds it against a plain run."""
    made = answer_inputs(t)
    rows = retrieval.answer(made.pop("questions"), made.pop("docs"), made.pop("vectors"), made.pop("query_vectors"), **made)
    return fusion.explained(rows, t.documents.select(F.col("doc_id").alias("item"), "text"), first=20).withColumn("related", F.array_join("related", ","))
