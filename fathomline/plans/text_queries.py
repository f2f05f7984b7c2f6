"""Queries of the text functions, chunks and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers as N
from ..functions import text as T
from ..operators import chunking, lexical, spans
from . import understanding
from .catalog import Tables, query

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_&/]+')"
WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"


@query(f"select term, count(distinct doc_id) as df, count(*) as total_freq from (select doc_id, unnest({TOKENS}) as term from documents) group by term")
def token_stats(t: Tables) -> DataFrame:
    return lexical.token_stats(t.documents)


@query(f"""
with s as (select term, count(distinct doc_id) as df from (select doc_id, unnest({TOKENS}) as term from documents) group by term),
n as (select count(*) as n from documents)
select term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) as idf from s, n""")
def idf_table(t: Tables) -> DataFrame:
    n = t.documents.agg(F.count("*").alias("n"))
    stats = lexical.token_stats(t.documents)
    return stats.crossJoin(F.broadcast(n)).select("term", "df", F.round(lexical.idf(F.col("n"), F.col("df")), 6).alias("idf"))  # n: one row


@query(r"""
with c as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\r\n', chr(10), 'g'), '\t', ' ', 'g'), ' {2,}', ' ', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '^\s+|\s+$', '', 'g') as x from pages)
select page_id, md5(x) as digest, length(x) as size from c""")
def clean_pages(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.clean_text("html").alias("x")).select("page_id", F.md5("x").alias("digest"), F.length("x").cast("long").alias("size"))


@query(r"""
with a as (select doc_id, replace(translate(text, chr(8211) || chr(8212) || chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(160) || chr(8203) || chr(8206) || chr(8207) || chr(65279), '--''''"" '), chr(8230), '...') as x from (select doc_id, nfc_normalize(text) as text from documents)),
b as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{ad}]', '', 'g'), '[ \t\r\f\x0b]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as x from a)
select doc_id, md5(x) as digest, length(x) as size from b""")
def normalize_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.normalize_text(T.nfc("text")).alias("x")).select("doc_id", F.md5("x").alias("digest"), F.length("x").cast("long").alias("size"))


@query(rf"""
select doc_id, md5(array_to_string(list_transform({WORDS}, lambda w: case when regexp_full_match(regexp_replace(w, '^[.,;:!?()\[\]{{}}"'']+|[.,;:!?()\[\]{{}}"'']+$', '', 'g'), '\p{{Lu}}{{1,6}}') then w else lower(w) end), ' ')) as digest from documents""")
def fold_case(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.fold_case("text")).alias("digest"))


def _stem_sql(word: str) -> str:
    cases = " ".join(f"when ends_with({word}, '{s}') and length({word}) - {len(s)} + {len(p)} >= 3 then substr({word}, 1, length({word}) - {len(s)}) || '{p}'" for s, p in T.SUFFIXES)
    return f"case when length({word}) <= 3 then {word} {cases} else {word} end"


@query(f"select {_stem_sql('term')} as stem, count(*) as total_freq, count(distinct term) as n_words from (select unnest({TOKENS}) as term from documents) group by 1")
def stem_tokens(t: Tables) -> DataFrame:
    """Words are counted first, so that each distinct word is stemmed once."""
    words = t.documents.select(F.explode(T.tokens("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return words.groupBy(T.stem("term").alias("stem")).agg(F.sum("n").alias("total_freq"), F.count("*").alias("n_words"))


@query(r"select p_partkey, array_to_string(list_filter(string_split_regex(lower(trim(p_type)), '[:/\-_\s]+'), lambda w: w <> ''), '|') as tokens from part")
def schema_tokens(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(T.schema_tokens("p_type"), "|").alias("tokens"))


@query(r"select c_custkey, regexp_replace(upper(trim('(' || c_name || ')')), '^[\[\(]+|[\]\)]+$', '', 'g') as ident, trim(regexp_replace(regexp_replace(regexp_replace(lower(c_mktsegment || ' (adj.) 1.5'), '[()]', ' ', 'g'), '\.([^\d]|$)', ' \1', 'g'), '\s+', ' ', 'g')) as metric from customer")
def normalize_names(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", T.normalize_identifier(F.concat(F.lit("("), "c_name", F.lit(")"))).alias("ident"), T.normalize_metric_name(F.concat("c_mktsegment", F.lit(" (adj.) 1.5"))).alias("metric"))


@query(rf"""
with w as (select conv_id, turn, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') as w from conversations),
g as (select unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as gram from w where len(w) >= 2)
select gram, count(*) as n from g group by gram""")
def word_bigrams(t: Tables) -> DataFrame:
    return t.conversations.select(F.explode(T.ngrams(T.words(F.lower("text")), 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(rf"""
with w as (select doc_id, {WORDS} as w from documents), n as (select doc_id, w, case when len(w) = 0 then 0 when len(w) <= 393 then 1 else 1 + cast(ceil((len(w) - 393) / 344.0) as bigint) end as n from w),
c as (select doc_id, w, unnest(range(0, n)) as i from n)
select doc_id, i as chunk_index, doc_id || ':chunk:' || i as chunk_id, len(w[i * 344 + 1 : i * 344 + 393]) as n_words, md5(array_to_string(w[i * 344 + 1 : i * 344 + 393], ' ')) as digest from c""")
def chunk_words(t: Tables) -> DataFrame:
    return chunking.chunks(t.documents).withColumn("digest", F.md5("text")).drop("text")


@query(rf"with n as (select doc_id, len({WORDS}) as n from documents) select doc_id, case when n = 0 then 0 when n <= 393 then 1 else 1 + cast(ceil((n - 393) / 344.0) as bigint) end as n_chunks, cast(floor(n * 1.3) as bigint) as n_tokens from n")
def chunk_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", chunking.chunk_count(F.size(T.words("text"))).alias("n_chunks"), T.token_estimate("text").alias("n_tokens"))


#: Sections of a web page, by its tags.
PAGE_SECTIONS = (("head", "<head"), ("title", "<title"), ("body", "<body"), ("script", "<script"), ("footer", "<footer"))
#: Every match of a pattern starts after the parts before it and the matches between them.
_FOUND = " union all ".join(f"select page_id, '{n}' as section, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)))::bigint as start, size from (select page_id, length(html) as size, string_split_regex(html, '(?is){p}') as p, regexp_extract_all(html, '(?is){p}') as m from pages)" for n, p in PAGE_SECTIONS)


@query(f"""select page_id as doc_id, section, start, coalesce(lead(start) over (partition by page_id order by start, section), size) as "end" from ({_FOUND}) where start >= 0""")
def page_sections(t: Tables) -> DataFrame:
    return chunking.sections(t.pages, PAGE_SECTIONS, "page_id", "html")


@query("select page_id, case when contains(h, 'annual report') or contains(h, 'form 10-k') then '10-K' when contains(h, 'quarterly report') or contains(h, 'form 10-q') then '10-Q' when contains(h, 'form 8-k') then '8-K' else '10-K' end as kind from (select page_id, lower(substr(html, 1, 2000)) as h from pages)")
def filing_type(t: Tables) -> DataFrame:
    return t.pages.select("page_id", chunking.filing_type(F.col("html")).alias("kind"))


_TITLE = "upper(substr(role, 1, 1)) || substr(role, 2)"


@query(rf"""
with x as (select conv_id, turn, 'Role ' || {_TITLE} || ' -- turn ' || turn as line from conversations),
c as (select conv_id, string_agg(line, chr(10) order by turn, line) as text from x group by conv_id)
select conv_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?m)^([A-Z][a-z]+ [A-Z][a-z]+)\s*[-–—]+\s*(.+)$', 1))), ',') as names from c""")
def transcript_speakers(t: Tables) -> DataFrame:
    line = F.concat(F.lit("Role "), F.initcap("role"), F.lit(" -- turn "), F.col("turn").cast("string"))
    lines = t.conversations.select("conv_id", line.alias("line"))
    # names are found line by line and then gathered: no conversation is put together in one row
    found = lines.select("conv_id", F.explode(chunking.speakers(F.col("line"))).alias("name")).distinct()
    return found.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


def questions(t: Tables) -> DataFrame:
    """A question for each order, of six kinds, with its year, quarter and status."""
    y, q = F.year("o_orderdate"), F.quarter("o_orderdate")
    kinds = (
        F.format_string("Compare MSFT vs AAPL gross margin in FY%d, not below Q%d %d", y - 1, q, y),
        F.format_string("Why did revenue decline in Q%d %d because of %s", q, y, "o_orderpriority"),
        F.format_string("What is the average operating margin and growth rate for fiscal year %d", y),
        F.format_string("Summarize the key takeaway of %dQ%d without debt", q, y % 100),
        F.format_string("Historical trend of net income over time, YoY and TTM since 20%02d", y % 100),
        F.format_string("Which companies have revenue greater than cash last year, status %s", "o_orderstatus"),
    )
    out = F.when(F.col("o_orderkey") % 6 == 0, kinds[0])
    for k in range(1, 6):
        out = out.when(F.col("o_orderkey") % 6 == k, kinds[k])
    return t.orders.select(F.col("o_orderkey").alias("question_id"), out.alias("text"))


_QUESTIONS = """q as (select o_orderkey as question_id, case o_orderkey % 6
 when 0 then printf('Compare MSFT vs AAPL gross margin in FY%d, not below Q%d %d', year(o_orderdate) - 1, quarter(o_orderdate), year(o_orderdate))
 when 1 then printf('Why did revenue decline in Q%d %d because of %s', quarter(o_orderdate), year(o_orderdate), o_orderpriority)
 when 2 then printf('What is the average operating margin and growth rate for fiscal year %d', year(o_orderdate))
 when 3 then printf('Summarize the key takeaway of %dQ%d without debt', quarter(o_orderdate), year(o_orderdate) % 100)
 when 4 then printf('Historical trend of net income over time, YoY and TTM since 20%02d', year(o_orderdate) % 100)
 else printf('Which companies have revenue greater than cash last year, status %s', o_orderstatus) end as text from orders)"""
_LONG = "case when length(regexp_extract(r, '(\\d+)$', 1)) = 4 then regexp_extract(r, '(\\d+)$', 1) else (2000 + cast(regexp_extract(r, '(\\d+)$', 1) as integer))::varchar end"
_PERIODS = (
    (r"\b(?:FY|fiscal\s*year)\s*(?:\d{4})\b", "FY", "'FY' || regexp_extract(r, '(\\d+)$', 1)"),
    (r"\bQ[1-4]\s*[''’]?\s*\d{2,4}\b", "Q", f"'Q' || regexp_extract(r, '([1-4])', 1) || ' ' || {_LONG}"),
    (r"\b[1-4]Q\s*[''’]?\s*\d{2,4}\b", "Q", f"'Q' || regexp_extract(r, '([1-4])', 1) || ' ' || {_LONG}"),
    (r"\b20\d{2}\b", "CY", "r"),
    (r"\b(?:last|prior|previous|trailing)\s+(?:year|quarter|month)\b", "REL", "upper(r)"),
    (r"\b(?:TTM|LTM|NTM)\b", "REL", "upper(r)"),
    (r"\b(?:YoY|QoQ|MoM)\b", "COMP", "upper(r)"),
)


@query(f"with {_QUESTIONS} " + " union all ".join(f"select question_id, '{kind}' as kind, {label} as label from (select question_id, unnest(regexp_extract_all(text, '(?i){p}')) as r from q)" for p, kind, label in _PERIODS))
def extract_periods(t: Tables) -> DataFrame:
    return questions(t).select("question_id", F.inline(T.periods("text")))


def _comparison_sql() -> str:
    return "case " + " ".join(f"when regexp_matches(text, '(?i){p}') then '{n}'" for n, p in T.COMPARISONS) + " end"


@query(f"with {_QUESTIONS} select question_id, {_comparison_sql()} as comparison, regexp_matches(text, '(?i){T.NEGATION}') as negated from q")
def detect_cues(t: Tables) -> DataFrame:
    return questions(t).select("question_id", T.comparison("text").alias("comparison"), T.has_negation("text").alias("negated"))


@query(rf"""with {_QUESTIONS}, w as (select question_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_&/]+') as w from q)
select question_id, len(list_filter(w, lambda x: regexp_full_match(x, '[A-Z]{{1,5}}'))) as n_entities, array_to_string(list_filter(w, lambda x: list_contains({T.METRIC_WORDS!r}, lower(x))), ',') as metrics from w""")
def question_mentions(t: Tables) -> DataFrame:
    return understanding.parsed(questions(t)).select("question_id", F.size("entities").cast("long").alias("n_entities"), F.array_join("metrics", ",").alias("metrics"))


def _share_sql(cues: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"cast(regexp_matches(text, '(?i){p}') as integer)" for p in cues) + f") / {len(cues)}.0"


_ROUTED = f"""{_QUESTIONS}, s as (select question_id, text, {", ".join(f"{_share_sql(c)} as s_{n}" for n, c in understanding.INTENTS.items())},
  len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_&/]+'), lambda x: regexp_full_match(x, '[A-Z]{{1,5}}'))) > 1 or coalesce({_comparison_sql()} = 'compare', false) as multi from q),
b as (select *, greatest({", ".join(f"s_{n}" for n in understanding.INTENTS)}) as top from s),
i as (select *, case when top = 0 then 'find_evidence' {" ".join(f"when s_{n} = top then '{n}'" for n in understanding.INTENTS)} end as intent from b),
r as (select *, case when top = 0 then 0.5 else round(cast(least(top * 2, 1.0) as double), 6) end as confidence,
  case when intent = 'explain' then 'C' when intent in ('find_evidence', 'compute') then case when multi then 'B' else 'A' end else 'B' end as tier from i),
g as (select *, intent in ('explain', 'trend') or tier = 'C' as needs_graph from r)"""


@query(f"""with {_ROUTED} select question_id, intent, cast(confidence as double) as confidence, tier, multi, needs_graph,
 'Intent=' || intent || ' (tier ' || tier || ')' || case when len(told) > 0 then '; signals: [' || array_to_string(list_transform(told[1:3], lambda x: printf('%s=%.2f', x.n, round(-x.s, 6))), ', ') || ']' else '' end || case when multi then '; multi-company' else '' end || case when needs_graph then '; graph-expansion' else '' end as reasoning from (select *, list_sort(list_filter([{", ".join(f"{{'s': -s_{n}::double, 'i': {i}, 'n': '{n}'}}" for i, n in enumerate(understanding.INTENTS))}], lambda x: x.s < 0)) as told from g)""")
def intent_route(t: Tables) -> DataFrame:
    rows = understanding.routed(understanding.parsed(questions(t)))
    return rows.select("question_id", "intent", F.col("confidence").cast("double").alias("confidence"), "tier", "multi", "needs_graph", understanding.reasoning(rows).alias("reasoning"))


@query(f"""with {_ROUTED} select intent, tier, cast(case when intent = 'screen' then 200 else 100 end as bigint) as lexical_k, cast(case when intent = 'screen' then 200 when intent = 'compute' then 50 else 100 end as bigint) as semantic_k,
 cast(case when intent = 'screen' then 200 else 100 end as bigint) as fusion_k, cast(case when tier in ('B', 'C') then 50 else 0 end as bigint) as rerank_k, cast(case when needs_graph or intent = 'compute' then 50 else 0 end as bigint) as graph_k,
 case when intent = 'compute' then 'data' when needs_graph then 'entity,data,knowledge' else '' end as graph_zones, count(*) as n from g group by all""")
def stage_settings(t: Tables) -> DataFrame:
    rows = understanding.stages(understanding.routed(understanding.parsed(questions(t))))
    keys = ["intent", "tier", "lexical_k", "semantic_k", "fusion_k", "rerank_k", "graph_k", "graph_zones"]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


@query(r"""select o_orderkey, case when abs(o_totalprice) >= 1e9 then printf('$%.1fB', round(o_totalprice / 1e9, 1)) when abs(o_totalprice) >= 1e6 then printf('$%.1fM', round(o_totalprice / 1e6, 1)) when abs(o_totalprice) >= 1e3 then printf('$%.1fK', round(o_totalprice / 1e3, 1)) else printf('$%.0f', o_totalprice) end as money,
 lpad(regexp_replace(o_orderkey::varchar, '^0+', ''), 10, '0') as padded, repeat('#', cast(greatest(0, least(20, floor(o_totalprice / 500000.0 * 20))) as integer)) || repeat('.', 20 - cast(greatest(0, least(20, floor(o_totalprice / 500000.0 * 20))) as integer)) as bar, substr(sha256('v1:' || o_orderkey), 1, 12) as tag from orders""")
def format_orders(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", N.money("o_totalprice").alias("money"), N.padded_id("o_orderkey").alias("padded"), N.bar("o_totalprice", 500000.0).alias("bar"), N.short_hash(N.key(F.lit("v1"), "o_orderkey")).alias("tag"))


@query("select p_partkey, to_json({'p_partkey': p_partkey, 'p_brand': p_brand, 'p_name': p_name, 'p_size': p_size}) as json from part")
def export_json_rows(t: Tables) -> DataFrame:
    from ..sources.sinks import json_rows

    return json_rows(t.part.select("p_partkey", "p_brand", "p_name", "p_size"), "p_partkey")


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as line_no from documents), c as (select *, len(string_split(line, ' ')) as k from l),
s as (select doc_id, line_no, line, coalesce(sum(k) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint as b, k from c),
w as (select doc_id, b + unnest(range(0, k)) as at_, unnest(string_split(line, ' ')) as word from s), e as (select doc_id, at_ from w where regexp_matches(word, '^[A-Z][a-z]+')),
i as (select doc_id, at_, at_ - row_number() over (partition by doc_id order by at_) as g from e), a as (select doc_id, min(at_) as a, max(at_) + 1 as z from i group by doc_id, g),
t as (select doc_id, sum(k)::bigint as n from c group by doc_id), h as (select doc_id, p as b, least(p + 120, n) as y from (select doc_id, n, unnest(range(0, n, 90)) as p from t)),
r as (select doc_id, 'chunk' as kind, b as no, b, y from h union all select doc_id, 'line', line_no, b, b + k from s)
select a.doc_id, a.a as span_start, a.z as span_end, kind, no, a.a >= b and a.z <= y as whole from a join r on a.doc_id = r.doc_id and a.a < r.y and r.b < a.z""")
def span_provenance(t: Tables) -> DataFrame:
    """Runs of capitalised words with the chunks and the lines that they touch, by places of words."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("words", F.split("line", " "))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("b_start", F.coalesce(F.sum(F.size("words")).over(before), F.lit(0)).cast("long"))
    places = lines.select("doc_id", "b_start", F.posexplode("words").alias("i", "word")).where(F.col("word").rlike("^[A-Z][a-z]+")).select("doc_id", (F.col("b_start") + F.col("i")).alias("at"))
    whole = lines.groupBy("doc_id").agg(F.sum(F.size("words")).cast("long").alias("n"))
    chunks = whole.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(90).cast("long"))).alias("b_start"))
    chunks = chunks.select("doc_id", F.lit("chunk").alias("kind"), F.col("b_start").alias("no"), "b_start", F.least(F.col("b_start") + 120, F.col("n")).alias("b_end"))
    own = lines.select("doc_id", F.lit("line").alias("kind"), F.col("line_no").cast("long").alias("no"), "b_start", (F.col("b_start") + F.size("words")).alias("b_end"))
    met = spans.overlapping(spans.runs(places, "doc_id"), chunks.unionByName(own), ["doc_id"])
    inside = (F.col("a_start") >= F.col("b_start")) & (F.col("a_end") <= F.col("b_end"))
    return met.select("doc_id", F.col("a_start").alias("span_start"), F.col("a_end").alias("span_end"), "kind", "no", inside.alias("whole"))
