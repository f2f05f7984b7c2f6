"""Typed tokens, builders, ingestion, registries and whole answers."""

import json
import re

import pytest
from pyspark.sql import functions as F

from fathomline.functions import tokens
from fathomline.operators import chunking, finance, graph_build, lexical, lexicon, vector, versioning
from fathomline.plans import catalog, ingest, understanding
from fathomline.sources import readers

catalog.load()


def test_narrative_tokens(spark):
    text = "In FY2024 revenue rose 12.5% to $3,100M USD; M&A hurt EPS growth, A/FY2023 and ttm 12."
    found = spark.createDataFrame([(text,)], "t string").select(F.inline(tokens.narrative_tokens("t"))).collect()
    assert all(text[r["start"] : r["end"]] == r["text"] for r in found)
    kinds = {r["text"]: (r["kind"], r["normalized"]) for r in found}
    assert kinds["FY2024"] == ("period", "FY2024") and kinds["12.5%"] == ("number", "12.5%") and kinds["$3,100M"] == ("number", "$3100M") and kinds["USD"] == ("currency", "USD")
    assert kinds["M&A"] == ("identifier", "M&A") and kinds["EPS"] == ("identifier", "EPS") and kinds["rose"] == ("narrative", "rose") and kinds["ttm 12"] == ("period", "TTM12")
    assert kinds["A/FY2023"] == ("narrative", "a/fy2023") and kinds["FY2023"][0] == "period"  # a word may start before a period
    assert [r["start"] for r in found] == sorted(r["start"] for r in found)


def test_spans_place_by_place():
    """Against a walk along the text that tries each kind at each place."""
    import random

    rnd = random.Random(3)
    kinds = [("period", r"(?i)\b(?:FY|CY|Q[1-4]|H[12]|TTM|LTM|YTD|MRQ)\s*\d{0,4}\b"), ("number", r"(?<!\w)[-+]?\$?\d[\d,]*\.?\d*[BMKbmk%]?(?!\w)"), ("currency", r"\b(?:USD|EUR)\b")]
    for _ in range(2000):
        text = "".join(rnd.choice(["FY", "Q1", " ", "20", "3", "USD", "a/b", "-", "$", "5,0", ".", "M", "x_y", "H2 "]) for _ in range(rnd.randrange(12)))
        at, want, mask = 0, [], set()
        while at < len(text):
            hit = next(((k, m) for k, p in kinds if (m := re.compile(p).match(text, at))), None)
            if hit:
                want.append((hit[0], at, hit[1].end()))
                mask |= set(range(at, hit[1].end()))
            at = hit[1].end() if hit else at + 1
        want += [("word", *m.span()) for m in re.finditer(r"\b[\w&/]+\b", text) if m.start() not in mask]
        assert sorted(tokens.spans(text, tokens.TYPED, tokens.WORD)) == sorted(want), repr(text)


def test_identifier_scan(spark):
    df = spark.createDataFrame([("US0378331005 BRK.B rest",), (None,)], "t string")
    got = df.select(tokens.identifier_spans("t").alias("x")).collect()
    assert [x["normalized"] for x in got[0]["x"]] == ["US0378331005", "BRK.B", "REST"] and got[1]["x"] is None


def test_company_graph(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"canonical_id": "c1", "name": "A", "ticker": "AAA", "sector": "Tech", "aliases": ["Al"]}]))
    nodes, edges = graph_build.companies(readers.read_companies(spark, str(tmp_path / "c.json")))
    assert {r["node"] for r in nodes.collect()} == {"c1", "ticker:AAA", "sector:Tech", "alias:Al"}
    assert {(r["src"], r["dst"], r["edge_type"]) for r in edges.collect()} == {("c1", "ticker:AAA", "listed_on"), ("c1", "sector:Tech", "belongs_to_sector"), ("alias:Al", "c1", "alias_of")}
    assert graph_build.find_nodes(nodes, zone="entity", sector="Tech").count() == 1
    assert graph_build.find_nodes(nodes, zone="entity", node_type="ticker", sector=None).count() == 1


def test_fact_and_claim_nodes(spark):
    st = spark.createDataFrame([("c1", 2023, 5.0, 0.0)], "company string, year int, revenue double, fcf double")
    facts = finance.facts(st, "company", ["revenue", "fcf"])
    nodes, edges = graph_build.facts(facts, "company")
    assert [r["node"] for r in nodes.collect()] == ["fact:c1:revenue:2023"] and edges.first()["src"] == "c1"
    reached = nodes.select("node")
    assert graph_build.expansion(reached, nodes).first()["text"] == "Metric=revenue; Period=FY2023; Value=5.0"
    cn, ce = graph_build.claims(spark.createDataFrame([("x buys y", ["x", "y"], "d1")], "text string, entities array<string>, doc_id string"))
    assert cn.count() == 1 and sorted(r["edge_type"] for r in ce.collect()) == ["derived_from", "mentioned_in_claim", "mentioned_in_claim"]


def test_lexicon_graph(spark):
    e = spark.createDataFrame([("e1", "rev", "m", "metric_alias", 0.5)], "entry_id string, surface_form string, canonical_id string, entry_type string, confidence double")
    m = spark.createDataFrame([("sales", "us:Rev", "us")], "surface_form string, concept string, taxonomy string")
    nodes, edges = graph_build.lexicon(e, m)
    assert {r["node"] for r in nodes.collect()} == {"lex:e1", "schema:us:Rev:sales"} and edges.count() == 2


def test_ingest(spark):
    text = "Item 1 Business\n" + "alpha " * 400 + "\nItem 1A Risk Factors\n" + "beta " * 60
    docs = spark.createDataFrame([(1, text, "s"), (2, "", "s"), (3, "short one", ""), (4, None, "s")], "doc_id long, text string, source string")
    made = ingest.ingest(docs, "run:9")
    rows = made.chunks.orderBy("doc_id", "chunk_index").collect()
    assert [(r["doc_id"], r["section"], r["chunk_index"]) for r in rows] == [(1, "Business", 0), (1, "Business", 1), (1, "Risk Factors", 2), (3, "", 0)]
    assert tuple(made.stats.first()) == (4, 2, 4, 4)
    assert made.vectors.count() == 4 and all(len(r["embedding"]) == 64 for r in made.vectors.collect())
    assert made.edges.where("edge_type = 'derived_from'").count() == 4


def test_parsed_by_type(spark):
    docs = spark.createDataFrame([(1, "ITEM 1A. Risk Factors x\nITEM 7. MD&A y", None), (2, "Prepared remarks a\nQ&A session b", "earnings_transcript"), (3, "news", "news")], "doc_id long, text string, doc_type string")
    got = sorted((r["doc_id"], r["section"]) for r in chunking.parsed(docs).collect())
    assert got == [(1, "item_1a"), (1, "item_7"), (2, "prepared_remarks"), (2, "qa_session"), (3, "full")]


def test_registry(spark):
    models = spark.createDataFrame([("p", "m", 64, 1), ("p", "m", 128, 2), ("q", "n", 8, 3)], "provider string, model_name string, dimensions int, seq int")
    rows = versioning.registered(models)
    assert {r["model_id"]: r["dimensions"] for r in rows.collect()} == {"p:m": 128, "q:n": 8}
    off = versioning.deactivated(rows, spark.createDataFrame([("p:m",)], "model_id string"))
    assert {r["model_id"]: r["active"] for r in off.collect()} == {"p:m": False, "q:n": True}
    gens = spark.createDataFrame([(1, "deprecated"), (2, "active"), (3, "active")], "seq int, status string")
    assert versioning.first_active(gens).first()["seq"] == 2
    state = versioning.state_rows(off, gens, gens)
    back = versioning.restored(state, "model", "model_id string, dimensions int, missing string")
    assert {tuple(r) for r in back.collect()} == {("p:m", 128, None), ("q:n", 8, None)}


def test_lexicon_upkeep(spark):
    a = spark.createDataFrame([("EPS", "earnings per share", "m:eps", 0), ("XYZ", "nothing", "", 1)], "abbreviation string, expansion string, metric_id string, seq int")
    assert [r["entry_id"] for r in lexicon.entries_of_abbreviations(a).collect()] == ["v1:m:eps:EPS"]
    asked = spark.createDataFrame([("eps",), ("foo",)], "token string")
    assert [tuple(r) for r in lexicon.expand_abbreviations(asked, a).collect()] == [("eps", "earnings per share", "m:eps")]
    entries = spark.createDataFrame([("v1:c:s", "s", "c")], "entry_id string, surface_form string, canonical_id string")
    assert lexicon.bumped(entries, "v2").first()["entry_id"] == "v2:c:s"
    df = spark.createDataFrame([(["Apple", "AAPL"], ["apple", "Mac", "MAC", "Pod"])], "o array<string>, n array<string>")
    assert df.select(lexicon.merged_aliases(F.col("o"), F.col("n")).alias("x")).first()["x"] == ["Apple", "AAPL", "Mac", "Pod"]


def test_trigram_fill_and_company_filter(spark):
    docs = spark.createDataFrame([(1, "cats", "Acme Corp", "c1"), (2, "dogs", "Acme Corporation", "c1"), (3, "cats", "Zeta", "c2")], "doc_id long, text string, name string, company_id string")
    terms = spark.createDataFrame([(7, "cats"), (8, "cats")], "query_id long, term string")
    hits = lexical.bm25(docs, terms)
    more = lexical.with_trigrams(hits, docs, spark.createDataFrame([(7, "acme corp")], "query_id long, mention string"))
    assert sorted((r["query_id"], r["doc_id"]) for r in more.collect()) == [(7, 1), (7, 2), (7, 3), (8, 1), (8, 3)]
    kept = lexical.one_company(hits, spark.createDataFrame([(7, "c2")], "query_id long, company_id string"), docs)
    assert sorted((r["query_id"], r["doc_id"]) for r in kept.collect()) == [(7, 3), (8, 1), (8, 3)]
    assert lexical.searchable("chunks", "text") == "text"
    with pytest.raises(ValueError):
        lexical.searchable("chunks", "secret")


def test_lsh_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = e.where("vec_id % 100 = 0")
    exact = {(r["query_id"], r["vec_id"]) for r in vector.nearest(e, asked, 10).collect()}
    near = {(r["query_id"], r["vec_id"]) for r in vector.lsh_nearest(e, asked, 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_answers(spark, sf):
    rows = catalog.QUERIES["answer_questions"](spark, sf).collect()
    assert rows and all(r["explanation"].startswith("Scores: ") for r in rows)
    assert max(r["rank"] for r in rows) <= 20 and len({(r["query_id"], r["item"]) for r in rows}) == len(rows)


def test_weights_and_balance(spark):
    assert finance.weights_add_up(finance.SCORE_WEIGHTS[:2] + (0.65,)) and not finance.weights_add_up((0.5, 0.4))
    df = spark.createDataFrame([(1, 100.0, 40.0, 60.5), (2, 100.0, 40.0, 90.0)], "k int, assets double, liabilities double, equity double")
    assert [r["k"] for r in finance.issues(df, "k", finance.balance_rules()).collect()] == [2]


def test_conditioned_and_reasoning(spark):
    df = spark.createDataFrame([("t", "A", ""), ("t", "", "")], "t string, a string, b string")
    assert [r[0] for r in df.select(vector.conditioned(F.col("t"), F.col("a"), F.col("b"))).collect()] == ["[A] t", "t"]
    q = understanding.routed(understanding.parsed(spark.createDataFrame([(1, "Compare MSFT vs AAPL"), (2, "Why?"), (3, "hello")], "query_id long, text string")))
    got = {r["query_id"]: (r["intent"], r["tier"]) for r in q.collect()}
    assert got == {1: ("compare", "B"), 2: ("explain", "C"), 3: ("find_evidence", "A")}


def test_expansion_and_planned_answers(spark):
    """A question's terms step by step; hits of the named company alone; what it reaches in the plan's zones."""
    from fathomline.operators.vector import hashed_embedding
    from fathomline.functions import text as T
    from fathomline.plans import expansion, retrieval

    entries = spark.createDataFrame([("e1", "sales", "m:rev", "Revenue", "metric_alias", 0.9), ("e2", "turnover", "m:rev", "Revenue", "metric_alias", 0.8)], "entry_id string, surface_form string, canonical_id string, canonical_label string, entry_type string, confidence double")
    tickers = spark.createDataFrame([("EPS", "c:1", "Epsilon", ["EPSX"], 1)], "ticker string, canonical_id string, company_name string, variants array<string>, seq int")
    short = spark.createDataFrame([("EPS", "earnings per share", "m:eps", 1)], "abbreviation string, expansion string, metric_id string, seq int")
    mapped = spark.createDataFrame([("net sales", "m:rev", "custom", "Revenue", 0.9)], "surface_form string, concept string, taxonomy string, label string, confidence double")
    asked = spark.createDataFrame([(1, "why did EPS and net sales fall in FY2023"), (2, ""), (3, "plain words")], "query_id long, text string")
    made = expansion.expanded(asked, entries, tickers, short, mapped)
    rows = {r["query_id"]: r for r in made.collect()}
    assert rows[1]["expanded"] == "why did EPS earnings per share and net sales fall in Revenue turnover"
    assert rows[1]["company_ids"] == ["c:1"] and rows[1]["periods"] == ["FY2023"]
    assert rows[2]["expanded"] == "" and rows[3]["expanded"] == "plain words" and rows[3]["company_ids"] == []

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["turnover fell", "net sales fell", "plain words here", "turnover rose"])], "doc_id long, text string")
    owners = spark.createDataFrame([(0, "c:1"), (1, "c:2"), (2, "c:2"), (3, "c:1")], "item long, company_id string")
    edges = spark.createDataFrame([("c:1", "fact:1", "has_fact", "data"), ("fact:1", "doc:9", "derived_from", "provenance"), ("c:1", "c:3", "competes_with", "entity")], "src string, dst string, edge_type string, zone string")
    embed = lambda df, i: df.select(F.col(i), hashed_embedding(T.tokens("text")).alias("embedding"))
    got = retrieval.answer(asked, docs, embed(docs, "doc_id").withColumnRenamed("doc_id", "item"), embed(asked, "query_id"), expansions=made, owners=owners, edges=edges).collect()
    assert {r["item"] for r in got if r["query_id"] == 1} == {0, 3} and {r["item"] for r in got if r["query_id"] == 3} >= {2}
    assert {tuple(r["related"]) for r in got if r["query_id"] == 1} == {("c:3", "fact:1")} and {tuple(r["related"]) for r in got if r["query_id"] == 3} == {()}
