"""The classifiers' parts against brute force, and held-out accuracy on the given tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import quality_classifier, queries, toxicity
from fathomline.llm.sampling import labelled_sample


def test_label_model_finds_accuracies_and_dependence():
    rng = np.random.default_rng(0)
    n, prior = 60_000, 0.2
    y = rng.random(n) < prior
    hit, false = np.array([0.7, 0.5, 0.6, 0.4, 0.65]), np.array([0.05, 0.02, 0.1, 0.01, 0.04])
    votes = rng.random((n, 5)) < np.where(y[:, None], hit, false)
    votes = np.column_stack([votes, votes[:, 4] ^ (rng.random(n) < 0.02)]).astype(float)
    model = toxicity.fit_label_model(n, votes.sum(0), votes.T @ votes, prior)
    assert np.abs(model.hit[:4] - hit[:4]).max() < 0.08 and np.abs(model.false[:4] - false[:4]).max() < 0.03
    assert model.dependent[4, 5] and model.weight[4] < 0.7 < model.weight[0]
    start, steps = model.logits()
    guess = start + votes @ steps > 0
    assert (guess == y).mean() > 0.93


def test_voters():
    voters = toxicity.Voters.of(["blorp", "snaf-", "snafu-"], toxicity.RULES)
    counts = dict(zip(voters.names, voters.counts("You are an IDIOT, idiot! Snafuing blorp blorp"), strict=True))
    assert counts["insults_en"] == 2 and counts["second_person"] == 1 and sum(v for k, v in counts.items() if k.startswith("learnt")) == 3
    assert not voters.counts("").any()


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_held_out(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for make, label, least in ((queries.op1_toxicity, "toxic", 0.85), (queries.op8_quality_classifier, "quality", 0.97)):
        rows = make(spark, sf).join(labels, "doc_id").where("held_out").select("score", "predicted", F.col(label).alias("y")).collect()
        good, bad = [r["score"] for r in rows if r["y"] == 1], [r["score"] for r in rows if r["y"] == 0]
        auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
        precision = sum(r["y"] for r in rows if r["predicted"]) / max(1, sum(r["predicted"] for r in rows))
        assert auc >= least and precision >= 0.95


def _edge(spark):
    rows = [(1, "you pathetic idiot, you worthless scum"), (2, None), (3, ""), (4, "word " * 50_000), (1, "again"), (None, "a fine text")]
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, label string, score double")


def test_toxicity_edges(spark):
    df = _edge(spark)
    got = toxicity.toxicity_scores(df).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(df, labels).count() == 6
    assert toxicity.toxicity_scores(df.limit(0), labels).count() == 0
    assert toxicity.toxicity_scores(df, labels.limit(0)).count() == 6


def test_toxicity_whatever_the_order_of_rows(spark, sf):
    """The same scores from one partition and from seven, with rows the other way round."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    runs = [{r["id"]: r["score"] for r in toxicity.toxicity_scores(d, k).collect()} for d, k in ((docs.coalesce(1), labels.coalesce(1)), (docs.orderBy(F.desc("doc_id")).repartition(7), labels.repartition(5)))]
    assert runs[0].keys() == runs[1].keys() and max(abs(runs[0][i] - runs[1][i]) for i in runs[0]) < 1e-6


def test_quality_edges(spark):
    df = _edge(spark)
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (3, None)], "doc_id long, quality int")
    for l in (labels, labels.limit(0), labels.where("quality = 1")):
        got = quality_classifier.quality_scores(df, l).collect()
        assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.quality_scores(df.limit(0), labels).count() == 0


def test_paths_and_rules(spark):
    debug = """Model
  Tree 0 (weight 1.0):
    If (feature 2 <= 0.5)
     If (feature 2 <= 0.25)
      Predict: 0.0
     Else (feature 2 > 0.25)
      Predict: 1.0
    Else (feature 2 > 0.5)
     Predict: 1.0
"""
    assert quality_classifier.paths(debug) == {((2, 0.5, False),), ((2, 0.25, False),), tuple(sorted([(2, 0.5, False), (2, 0.25, True)])), ((2, 0.5, True),)}
    model = quality_classifier.Ensemble(0.5, [(2.0, ((0, 1.0, True),)), (-1.0, ((0, 3.0, True), (1, 0.0, False)))])
    df = spark.createDataFrame([([0.0, 0.0],), ([2.0, 0.0],), ([4.0, 0.0],)], "stats array<double>")
    got = [r[0] for r in df.select(model.score([F.element_at("stats", 1), F.element_at("stats", 2)])).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-x)) for x in (0.5, 2.5, 1.5)])


def test_statistics():
    rnd = random.Random(0)
    for text in ["", "a", "Aa!! BB!! Aa!!", "x | y | z", "w " * 100, "\n\n"] + ["".join(rnd.choice("aB1!| \né") for _ in range(80)) for _ in range(50)]:
        s = dict(zip(quality_classifier.STATS, quality_classifier.text_stats(text), strict=True))
        w = text.split()
        assert np.isfinite(list(s.values())).all()
        assert s["distinct_words"] == pytest.approx(len(set(w)) / max(1, len(w)))
        assert s["bang_share"] == pytest.approx(text.count("!") / max(1, len(w)))


def test_labelled_sample_is_bounded(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    assert 350 < labelled_sample(labels, "doc_id", "toxic", 500).count() < 650
    twice = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1)], "doc_id long, toxic int")
    assert [r["key"] for r in labelled_sample(twice, "doc_id", "toxic", 500).collect()] == [2]


def test_quality_scores_rule_by_rule(spark, sf):
    """Each whole text's score, summed in plain Python; the weights solve the lasso's own conditions on the training rows."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = {r["key"]: r["label"] for r in labelled_sample(labels, "doc_id", "quality", 20_000).collect()}
    stats = quality_classifier.stat_table(docs)
    model = quality_classifier.fit(stats, labelled_sample(labels, "doc_id", "quality", 20_000))
    told = {r["id"]: r["s"] for r in stats.select("id", model.score([F.element_at("stats", k + 1) for k in range(len(quality_classifier.STATS))]).alias("s")).collect()}
    holds = lambda rule, s: all(s[k] > t if above else s[k] <= t for k, t, above in rule)
    rows, residual = [], []
    for r in docs.collect():
        s = quality_classifier.text_stats(r["text"] or "")
        held = np.array([holds(rule, s) for _, rule in model.rules], float)
        p = 1 / (1 + math.exp(-(model.start + held @ np.array([w for w, _ in model.rules]))))
        assert told[r["doc_id"]] == pytest.approx(p, abs=1e-9)
        if r["doc_id"] in known:
            rows.append(held)
            residual.append(p - known[r["doc_id"]])
    slope, signs = np.array(residual) @ np.array(rows) / len(rows), np.sign([w for w, _ in model.rules])
    assert len(model.rules) >= 3 and abs(np.mean(residual)) < 2e-3
    assert np.abs(slope + quality_classifier.RULES.penalty * signs).max() < 2e-3


def test_toxicity_against_a_plain_fit(spark, sf):
    """Votes, posteriors and the classifier once more, with loops and Newton's steps in NumPy."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["id"]: r for r in toxicity.toxicity_scores(docs).collect()}
    voters = toxicity.Voters.of([], toxicity.RULES, [])
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    counts = np.array([voters.counts(t) for t in texts.values()], float)
    votes = (counts > 0).astype(float)
    start, steps = toxicity.fit_label_model(len(votes), votes.sum(0), votes.T @ votes, toxicity.RULES.prior).logits()
    p = 1 / (1 + np.exp(-(start + votes @ steps)))
    assert np.allclose(p, [got[i]["posterior"] for i in texts], atol=1e-9)
    x = np.column_stack([np.log1p(counts), np.log1p(votes.sum(1)), np.log1p(counts.sum(1))])
    # Spark scales by the unbiased deviation of weighted rows: texts with the same counts are two rows, of weights n p and n (1 - p).
    alike, size = np.unique(np.column_stack([x, p]), axis=0, return_counts=True)
    w = np.concatenate([size * alike[:, -1], size * (1 - alike[:, -1])])
    spread = np.sqrt(((x - x.mean(0)) ** 2).sum(0) / (len(x) - (w @ w) / len(x)))
    x = np.column_stack([np.divide(x, spread, where=spread > 0, out=np.zeros_like(x)), np.ones(len(x))])
    ridge = np.diag([1e-4] * (x.shape[1] - 1) + [1e-12])
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        q = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.lstsq((x * (q * (1 - q))[:, None]).T @ x / len(x) + ridge, x.T @ (q - p) / len(x) + ridge @ beta, rcond=None)[0]
    assert np.abs(1 / (1 + np.exp(-x @ beta)) - [got[i]["score"] for i in texts]).max() < 2e-3
