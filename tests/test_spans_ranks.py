"""Span joins and ranks by ranges against brute force."""

import random

from pyspark.sql import functions as F

from fathomline.operators import ranking, spans


def test_overlapping_spans(spark):
    rnd = random.Random(3)
    make = lambda n, top: [(rnd.choice("xyz"), i, a, a + rnd.randrange(0, top)) for i in range(n) for a in [rnd.randrange(900)]]
    left, right = make(150, 20), make(80, 400) + [("x", 900, None, 5), (None, 901, 0, 10)]
    a, b = spark.createDataFrame(left, "k string, a long, a_start long, a_end long"), spark.createDataFrame(right, "k string, b long, b_start long, b_end long")
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and y[2] is not None and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])
    for size in (16, 128):
        met = spans.overlapping(a, b, ["k"], size=size)
        assert sorted((r["a"], r["b"]) for r in met.collect()) == want
    inside = sorted((r["a"], r["b"]) for r in spans.contained(met).collect())
    at = {x[1]: x for x in left}, {y[1]: y for y in right}
    assert inside == [(i, j) for i, j in want if at[0][i][2] >= at[1][j][2] and at[0][i][3] <= at[1][j][3]]


def test_ranks_by_ranges(spark):
    """The ranks of a window, though one group holds nearly all rows; no range holds twice the mean."""
    rnd = random.Random(4)
    rows = [(None if i % 97 == 0 else "big" if i % 50 else f"g{i % 7}", rnd.randrange(40), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, v long, id long").repartition(3)
    for order in ([F.desc("v"), F.asc("id")], [F.asc("v"), F.asc("id")]):
        got = ranking.ranked_by_ranges(df, ["g"], order, size="n")
        want = ranking.ranked(df, ["g"], order)
        assert sorted(map(tuple, got.drop("n").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        sizes = {r["g"]: r["n"] for r in got.collect()}
        assert sizes == {g: sum(r[0] == g for r in rows) for g in sizes}
    parts = df.repartitionByRange(8, "g", F.desc("v"), F.asc("id")).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 2 * 6000 / len(parts)
