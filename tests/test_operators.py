"""Operators on small frames, against values worked out by hand or brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import chunking, evaluation, finance, fusion, graph, lexicon, monitoring, ranking, vector
from fathomline.sources import sinks
from fathomline.streaming import windows


def test_rrf_is_symmetric(spark):
    hits = spark.createDataFrame([(1, "a", 10, 1, 5.0), (1, "a", 11, 2, 4.0), (1, "b", 11, 1, 0.9), (1, "b", 12, 2, 0.8)], "query_id long, channel string, item long, rank long, score double")
    got = {r["item"]: r["fused"] for r in fusion.reciprocal_ranks(hits).collect()}
    assert got == {10: round(1 / 61, 6), 11: round(1 / 61 + 1 / 62, 6), 12: round(1 / 62, 6)}
    turned = hits.withColumn("channel", F.when(F.col("channel") == "a", "b").otherwise("a"))
    assert {r["item"]: r["fused"] for r in fusion.reciprocal_ranks(turned).collect()} == got
    maps = {r["item"]: r["source_ranks"] for r in fusion.source_maps(hits).collect()}
    assert maps[11] == {"a": 2, "b": 1}


def test_blend_of_constant_channel(spark):
    hits = spark.createDataFrame([(1, "lexical", 1, 1, 2.0), (1, "lexical", 2, 2, 2.0)], "query_id long, channel string, item long, rank long, score double")
    assert {r["fused"] for r in fusion.weighted_blend(hits).collect()} == {0.0}


def test_ranking_metrics(spark):
    run = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "z", 3)], "query_id long, item string, rank long")
    rels = spark.createDataFrame([(1, "x", 1), (1, "z", 2), (1, "w", 1)], "query_id long, item string, rel int")
    pr = {r["k"]: (r["precision"], r["recall"]) for r in evaluation.precision_recall(run, rels).collect()}
    assert pr[1] == (1.0, round(1 / 3, 6)) and pr[3] == (round(2 / 3, 6), round(2 / 3, 6))
    dcg = 1 + 3 / math.log2(4)
    ideal = 3 + 1 / math.log2(3) + 1 / math.log2(4)
    assert {r["k"]: r["ndcg"] for r in evaluation.ndcg(run, rels).collect()}[3] == pytest.approx(dcg / ideal, abs=1e-6)
    ap = evaluation.average_precision(run, rels).first()
    assert ap["ap"] == pytest.approx((1 + 2 / 3) / 3, abs=1e-6) and ap["rr"] == 1.0


@pytest.mark.parametrize(("n", "chunks"), [(0, 0), (1, 1), (393, 1), (394, 2), (737, 2), (738, 3)])
def test_chunks(spark, n, chunks):
    words = [f"w{i}" for i in range(n)]
    rows = chunking.chunks(spark.createDataFrame([(7, " ".join(words))], "doc_id long, text string")).orderBy("chunk_index").collect()
    assert len(rows) == chunks
    assert [r["text"].split() for r in rows] == [words[i * 344 : i * 344 + 393] for i in range(chunks)]
    assert chunks == spark.range(1).select(chunking.chunk_count(F.lit(n))).first()[0]


def test_sections(spark):
    text = "intro Item 7. Management's Discussion x Item 1A Risk Factors y"
    got = chunking.sections(spark.createDataFrame([(1, text)], "doc_id long, text string"), chunking.FILING_SECTIONS).orderBy("start").collect()
    assert [(r["section"], text[r["start"] : r["end"]]) for r in got] == [("MD&A", text[6:40]), ("Risk Factors", text[40:])]


def test_speakers(spark):
    df = spark.createDataFrame([("John Smith -- CEO\nhello\nAnn Lee - CFO\nJohn Smith -- CEO",)], "t string")
    assert df.select(chunking.speakers(F.col("t")).alias("s")).first()["s"] == ["John Smith", "Ann Lee"]


def test_resolution_chain(spark):
    tickers = spark.createDataFrame([("c:1", "AAPL", ["Apple"], "Apple Inc", 0), ("c:2", "MSFT", None, "Microsoft", 1)], "canonical_id string, ticker string, variants array<string>, company_name string, seq int")
    entries = spark.createDataFrame([("e1", "gross margin", "m:gm", "Gross margin", "metric_alias", 0.9), ("e2", "Gross Margin", "m:gm2", "Other", "metric_alias", 0.8)], "entry_id string, surface_form string, canonical_id string, canonical_label string, entry_type string, confidence double")
    asked = spark.createDataFrame([("aapl",), (" apple ",), ("GROSS MARGIN",), ("Microsft Msft",), ("gross margins",), ("zzzz",), ("",)], "mention string")
    got = {r["mention"]: (r["canonical_id"], r["method"]) for r in lexicon.resolve(asked, entries, tickers).collect()}
    assert got["aapl"] == ("c:1", "exact_ticker") and got["apple"] == ("c:1", "exact_ticker")
    assert got["GROSS MARGIN"] == ("m:gm", "exact_alias")
    assert got["gross margins"] == ("m:gm", "trigram_alias") and got["Microsft Msft"][1] == "trigram_ticker"
    resolved = lexicon.resolve(asked, entries, tickers)
    assert [r["mention"] for r in lexicon.unresolved(asked, resolved).collect()] == ["zzzz"]
    assert {r["role"] for r in lexicon.routed(resolved).collect()} == {"company", "metric"}
    made = lexicon.entries_of_tickers(tickers).orderBy("entry_id").collect()
    assert [(r["surface_form"], r["confidence"]) for r in made] == [("AAPL", 1.0), ("Apple", 0.95), ("MSFT", 1.0)]


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "k string, x int, y int")
    new = spark.createDataFrame([("b", 9, 99), ("c", 3, 30)], "k string, x int, y int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(lexicon.upsert(old, new, "k", ["y"])) == [("a", 1, 10), ("b", 2, 99), ("c", 3, 30)]
    assert rows(lexicon.insert_new(old, new, "k")) == [("a", 1, 10), ("b", 2, 20), ("c", 3, 30)]
    assert rows(sinks.upsert_counts(old, new, "k", ["x", "y"])) == [("a", 1, 10), ("b", 9, 99), ("c", 3, 30)]
    assert rows(sinks.delete(old, new, "k")) == [("a", 1, 10)]
    assert rows(ranking.last_wins(old.unionByName(new).withColumn("s", F.col("y")), ["k"], "s").drop("s")) == [("a", 1, 10), ("b", 9, 99), ("c", 3, 30)]


def _graph(spark, seed=3, n=40, m=45):
    rnd = random.Random(seed)
    return [(f"n{rnd.randrange(n):02d}", f"n{rnd.randrange(n):02d}") for _ in range(m)]


def test_components_and_traversal(spark):
    pairs = _graph(spark)
    edges = spark.createDataFrame(pairs, "src string, dst string")
    near: dict[str, set] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def reach(x, follow):
        seen, todo = {x: 0}, [x]
        while todo:
            y = todo.pop(0)
            for z in follow(y):
                if z not in seen:
                    seen[z] = seen[y] + 1
                    todo.append(z)
        return seen

    looped = {x for x in near if near[x] != {x}}
    want = {x: min(reach(x, near.get)) for x in looped}
    assert {r["node"]: r["component"] for r in graph.connected_components(edges).collect()} == want
    starts = spark.createDataFrame([("n01",), ("n07",)], "node string")
    got = {(r["start"], r["node"]): r["depth"] for r in graph.traverse(starts, edges, 3).collect()}
    out = {s: {y: d for y, d in reach(s, lambda x: [b for a, b in pairs if a == x]).items() if d <= 3} for s in ("n01", "n07")}
    assert got == {(s, y): d for s, m in out.items() for y, d in m.items()}


def test_chain_components(spark):
    n = 300
    edges = spark.range(n).select((F.col("id") * 7 % n).alias("src"), (F.col("id") * 7 % n + 1).alias("dst"))
    assert graph.connected_components(edges).agg(F.countDistinct("component")).first()[0] == 1


def test_label_propagation(spark):
    pairs = sorted(set(_graph(spark, 5)))
    got = {r["node"]: r["label"] for r in graph.label_propagation(spark.createDataFrame(pairs, "src string, dst string"), 3).collect()}
    near: dict[str, list] = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    labels = {x: x for x in near}
    for _ in range(3):
        votes = {x: Counter(labels[y] for y in near[x]) for x in near}
        labels = {x: min(k for k, c in v.items() if c == max(v.values())) for x, v in votes.items()}
    assert got == labels


def test_nearest(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(5)]) for i in range(60)] + [(60, [0.0] * 5), (61, None), (62, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in vector.nearest(df, df.where("vec_id < 3"), 4).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (math.hypot(*a) * math.hypot(*b) or 1) if any(a) and any(b) else 0.0
    for q in range(3):
        best = sorted((-round(cos(rows[q][1], v), 6), i) for i, v in rows[:61] if i != q)[:4]
        assert [got[q, k + 1] for k in range(4)] == [i for _, i in best]


def test_nearest_with_too_many_queries_to_broadcast(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rnd.standard_normal(8).tolist()) for i in range(60)], "vec_id long, embedding array<double>").repartition(3)
    want = sorted(map(tuple, vector.nearest(df, df.where("vec_id % 3 = 0"), 5).collect()))
    monkeypatch.setattr(vector, "BROADCAST_BYTES", 300)
    assert sorted(map(tuple, vector.nearest(df, df.where("vec_id % 3 = 0"), 5).collect())) == want and len(want) == 100


@pytest.mark.parametrize("n", [1, 20, 21, 100, 101, 250])
def test_nearest_rank(spark, n):
    values = [float(i * 37 % 101) for i in range(n)]
    r = monitoring.nearest_rank(spark.createDataFrame([("a", v) for v in values], "k string, v double"), "k", "v").first()
    v = sorted(values)
    assert (r["count"], r["p50"], r["p95"], r["p99"], r["max"]) == (n, v[n // 2], v[int(n * 0.95)] if n > 20 else v[-1], v[int(n * 0.99)] if n > 100 else v[-1], v[-1])


def test_drift(spark):
    df = spark.createDataFrame([(2.0, 1.0), (0.5, 0.0), (3.0, None)], "c double, b double")
    assert [r[0] for r in df.select(monitoring.drift(F.col("c"), F.col("b"))).collect()] == [1.0, 0.5, 0.0]


def test_statement_checks(spark):
    df = spark.createDataFrame([(1, -5.0, 1.0, 9.0, 20.0), (2, 10.0, 4.0, 6.0, 1.0)], "k int, revenue double, cost double, gross_profit double, net_income double")
    got = sorted(map(tuple, finance.issues(df, "k", finance.statement_rules()).collect()))
    assert got == [(1, "error", "negative_revenue"), (1, "warning", "gross_profit_mismatch"), (1, "warning", "net_margin_outside")]


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(windows.events_stream(spark, str(tmp_path / "in"), events.schema))
    windows.run_once(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    rows = lambda df: Counter(map(tuple, df.collect()))
    got, whole = rows(spark.read.parquet(str(tmp_path / "out"))), rows(windows.tumbling(events))
    assert got and not got - whole  # the last windows stay open
    last = max(r[1] for r in whole) 
    assert all((last - r[1]).total_seconds() <= 900 for r in (whole - got))
