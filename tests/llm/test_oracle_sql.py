"""The ten queries that have SQL, against DuckDB on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from fathomline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found, wanted = queries.queries()[name](spark, sf), con.sql(queries.ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    at = [wanted.columns.index(c) for c in columns]
    assert Counter(map(tuple, found.select(*columns).collect())) == Counter(tuple(r[i] for i in at) for r in wanted.fetchall())


def test_pipeline(spark, sf):
    """Each stage on what the one before kept; the run's rows are those of the stages, one after another."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    rows = lambda df: Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in df.collect())
    assert rows(last) == rows(corpus_pipeline.run(spark, sf))


def test_pipeline_keeps_the_mixture(spark):
    """The last stage returns the order of the mixture, however its input's rows lie in files."""
    import corpus_pipeline

    docs = spark.createDataFrame([(i, "some words " * 4000, "abc"[min(i % 5, 2)]) for i in range(40)], "doc_id long, text string, source string")
    want = [(r["id"], r["slot"], r["place"]) for r in corpus_pipeline.mixing.mix(docs).orderBy("slot", "place").collect()]
    got = corpus_pipeline.tokens(spark, docs.repartition(7), "").collect()
    assert [(r["doc_id"], r["slot"], r["place"]) for r in got] == want
    sources, total = dict(docs.select("doc_id", "source").collect()), {s: n for s, n in docs.groupBy("source").count().collect()}
    weights = {s: n**0.5 / sum(m**0.5 for m in total.values()) for s, n in total.items()}
    served = {s: {r["slot"] for r in got if sources[r["doc_id"]] == s} for s in total}
    until = min(map(max, served.values())) + 1  # while all sources have blocks left
    for slots in range(1, until + 1):
        for s, w in weights.items():
            assert abs(sum(x < slots for x in served[s]) - slots * w) < 1


def test_pipeline_edges(spark):
    """Nulls in any column, empty and long texts, repeated ids and rows, clashing names; and an empty table."""
    import random

    import corpus_pipeline

    rnd = random.Random(5)
    prose = lambda n: " ".join("".join(rnd.choice("aeinorstlu") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    a, b, long = prose(120), prose(150), prose(30_000)
    rows = [(1, a, "x"), (2, b, None), (2, long, "y"), (3, a, "x"), (2, b, None), (4, None, "x"), (5, "", "x"), (None, prose(90), None), (6, prose(80), "z")]
    docs = spark.createDataFrame([(i, t, s, len(t or ""), "en", 7, 8, "k") for i, t, s in rows], "doc_id long, text string, source string, n_chars long, lang string, id long, slot int, mark string")
    for table in (docs, docs.limit(0)):
        kept = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, "").cache()
            assert kept.columns == docs.columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, kept, "").collect()
        want = sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect())
        assert len(last) == len(want)
    full = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        full = stage(spark, full, "")
    assert sorted((r["doc_id"] or -1, len(r["text"])) for r in full.collect()) == sorted([(1, len(a)), (2, len(b)), (2, len(long)), (-1, len(rows[7][1])), (6, len(rows[8][1]))])
