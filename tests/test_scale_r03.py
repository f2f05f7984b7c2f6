"""Steps that grew faster than their input."""

from pyspark.sql import functions as F

from fathomline.functions import tokens
from fathomline.plans import catalog


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_are_not_cut_out_of_the_text_one_by_one(spark, sf):
    """Spark's substring walks from the start of the text: a cut a token is quadratic in the text's length."""
    df = spark.createDataFrame([(1, "Größe " * 3000 + "FY 2024 \U0001f600 $1,234.5 EPS")], "id long, text string")
    found = df.select(F.inline(tokens.narrative_tokens("text")))
    assert "substring" not in plan_of(found)
    rows = found.collect()
    assert [r["text"] for r in rows[:2]] == ["Größe", "Größe"] and (rows[1]["start"], rows[1]["end"]) == (6, 11)
    assert [(r["text"], r["kind"], r["normalized"]) for r in rows[3000:]] == [("FY 2024", "period", "FY2024"), ("$1,234.5", "number", "$1234.5"), ("EPS", "identifier", "EPS")]
    catalog.load()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain = docs.select(F.explode(tokens.narrative_tokens("text")).alias("k")).groupBy("k.kind", "k.normalized").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, catalog.QUERIES["narrative_kinds"](spark, sf).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_lsh_makes_no_row_a_pair(spark):
    """All vectors share their buckets here: the pairs of a join would be rows of a shuffle."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector

    from fathomline.operators import vector

    rng = __import__("random").Random(3)
    rows = [(i, [1 + rng.random() / 2 for _ in range(8)]) for i in range(400)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = e.where("vec_id % 20 = 0")
    found = vector.lsh_nearest(e, asked, 5)
    assert "hashes" not in plan_of(found)
    unit = Normalizer(inputCol="v", outputCol="unit")
    of = lambda df: unit.transform(df.select("vec_id", array_to_vector("embedding").alias("v")))
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=0.7, numHashTables=8, seed=7).fit(of(e))
    pairs = model.approxSimilarityJoin(of(asked), of(e), 1.3, "d").where("datasetA.vec_id <> datasetB.vec_id")
    want = {}
    for q, v, d in pairs.select("datasetA.vec_id", "datasetB.vec_id", "d").collect():
        want.setdefault(q, []).append((-round(1 - d * d / 2, 6), v))
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found.collect()) == sorted((q, n, v) for q, x in want.items() for n, (_, v) in enumerate(sorted(x)[:5], 1))


def test_nearest_reads_a_pair_of_blocks_at_a_time(spark, monkeypatch):
    """However many blocks a batch holds; the best of many blocks are those of all rows."""
    from fathomline.operators import vector

    monkeypatch.setattr(vector, "BLOCK", 16)
    monkeypatch.setattr(vector, "HELD_BYTES", 1)
    rng = __import__("random").Random(5)
    v = {i: [rng.random() for _ in range(4)] for i in range(200)}
    e = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>").repartition(2)
    found = vector.nearest(e, e.where("vec_id % 10 = 0"), 7, "dot")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = [(q, n, i) for q in range(0, 200, 10) for n, (_, i) in enumerate(sorted((-round(dot(v[q], v[i]), 6), i) for i in v if i != q)[:7], 1)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found.collect()) == want


def test_the_best_by_bm25_without_a_row_a_pair(spark, monkeypatch):
    from fathomline.operators import lexical

    monkeypatch.setattr(lexical, "DOCS", 7)
    monkeypatch.setattr(lexical, "PAIRS", 6)
    monkeypatch.setattr(lexical, "CELLS", 10)
    rng = __import__("random").Random(2)
    docs = spark.createDataFrame([(i, None if i == 5 else " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(9)))) for i in range(60)] + [(60, "w1 w2")] * 1, "doc_id long, text string").repartition(3)
    terms = lexical.query_terms(spark.createDataFrame([(q, " ".join(f"w{rng.randrange(14)}" for _ in range(3))) for q in range(8)] + [(8, "nowhere w1")], "query_id long, text string"), "query_id", "text")
    found = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    for mode in ("or", "and"):
        top = lexical.bm25_top(docs, terms, 5, mode=mode)
        assert found(top) == found(lexical.best(lexical.bm25(docs, terms, mode=mode), 5))
    kinds = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1.7).otherwise(0.4).alias("factor"), F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("c"), (F.col("doc_id") % 2).cast("string"))).alias("company_id"))
    named = spark.createDataFrame([(0, ["c1"]), (1, []), (2, ["c0", "c1"]), (3, ["none"])], "query_id long, company_ids array<string>")
    plain = lexical.bm25(docs, terms).join(kinds, "doc_id").withColumn("score", F.round(F.col("score") * F.col("factor"), 6)).select("query_id", "doc_id", "score")
    plain = lexical.best(lexical.of_companies(plain, named, kinds), 4)
    assert found(lexical.bm25_top(docs, terms, 4, factors=kinds, owners=kinds, companies=named)) == found(plain)


def test_only_shown_items_are_tokenised_for_the_overlap(spark):
    from fathomline.operators import lexical

    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "a")], "doc_id long, text string")
    terms = spark.createDataFrame([(0, "a"), (0, "c")], "query_id long, term string")
    rows = lexical.item_terms(docs, spark.createDataFrame([(1,), (2,), (2,)], "item long"), terms)
    assert sorted(map(tuple, rows.select("item", "term").collect())) == [(1, "a"), (2, "c")]


def test_headings_are_looked_for_where_their_first_word_stands(spark):
    from fathomline.operators import chunking

    assert [chunking._first_word(p) for p in ("Item\\s+2", "(?:Closing|Concluding)\\s+R", "Notes?\\s+to", "Part I|Item", "Q&A")] == ["item", None, None, None, None]
    docs = spark.createDataFrame([(1, "x ITEM 2: Properties a"), (2, "no heading"), (3, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["section"], r["start"], r["end"]) for r in chunking.sections(docs, chunking.FILING_SECTIONS).collect()] == [(1, "Properties", 2, 22)]


def test_rows_a_word_of_all_questions_are_not_broadcast(spark, sf):
    """Spark estimates exploded words by the bytes of their file, and sent them to the driver as the smaller side."""
    plan = catalog_plan(spark, sf, "seed_expansions")
    assert "BuildLeft" not in plan and "BuildRight" in plan
    plan = catalog_plan(spark, sf, "expand_full")
    assert "LeftAnti, BuildRight" not in plan and "LeftOuter, BuildRight" not in plan and "BuildLeft" not in plan


def catalog_plan(spark, sf, name):
    catalog.load()
    return catalog.QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
