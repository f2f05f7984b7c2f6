"""Tables kept by key, against the whole-table forms, and the data source of saved filings."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fathomline.operators import ranking
from fathomline.sources import filings_source, keyed, readers, sinks

SCHEMA = "k long, a string, b double"


def rows(spark, n, tag, step=1):
    return spark.createDataFrame([(i, f"{tag}{i}", float(i)) for i in range(0, n, step)], SCHEMA)


def files(path):
    return {str(f) for f in path.rglob("*.parquet")}


def found(spark, path):
    return Counter(tuple(r) for r in keyed.read(spark, str(path), SCHEMA).select("k", "a", "b").collect())


def test_upsert_and_removal_rewrite_only_their_buckets(spark, tmp_path):
    path, old = tmp_path / "t", rows(spark, 200, "old")
    keyed.create(old, str(path), "k", buckets=16)
    before, new = files(path), spark.createDataFrame([(5, "new", None), (1000, "new", 1.0), (5, "new", None), (None, "x", 1.0)], SCHEMA)
    touched = keyed.upsert(spark, str(path), new, "k", SCHEMA, buckets=16)
    assert 1 <= len(touched) <= 2
    want = sinks.upsert_vectors(old, new.where("k is not null").distinct(), "k")
    assert found(spark, path) == Counter(map(tuple, want.collect()))
    same = {f for f in before if not any(f"bucket={b}/" in f for b in touched)}
    assert same and same <= files(path) and not (before - same) & files(path)
    gone = spark.createDataFrame([(5,), (7,), (4000,)], "k long")
    keyed.remove(spark, str(path), gone, "k", SCHEMA, buckets=16)
    assert found(spark, path) == Counter(map(tuple, sinks.delete(want, gone, "k").collect()))
    keyed.remove(spark, str(path), spark.createDataFrame([(i,) for i in range(1001)], "k long"), "k", SCHEMA, buckets=16)
    assert not found(spark, path)
    assert keyed.upsert(spark, str(path), new.limit(0), "k", SCHEMA, buckets=16) == []


def test_replaced_columns_and_first_wins(spark, tmp_path):
    path = tmp_path / "t"
    keyed.create(rows(spark, 4, "old"), str(path), "k", buckets=4)
    keyed.upsert(spark, str(path), spark.createDataFrame([(1, "new", 9.0), (2, "new", None), (8, "new", 8.0)], SCHEMA), "k", SCHEMA, buckets=4, replaced=["b"])
    want = {(0, "old0", 0.0), (1, "old1", 9.0), (2, "old2", 2.0), (3, "old3", 3.0), (8, "new", 8.0)}
    assert set(found(spark, path)) == want
    keyed.upsert(spark, str(path), spark.createDataFrame([(1, "x", 0.0), (9, "x", 9.0)], SCHEMA), "k", SCHEMA, buckets=4, first_wins=True)
    assert set(found(spark, path)) == want | {(9, "x", 9.0)}


def test_a_job_that_fails_leaves_the_old_rows(spark, tmp_path):
    path = tmp_path / "t"
    keyed.create(rows(spark, 50, "old"), str(path), "k", buckets=4)
    before = found(spark, path)
    bad = rows(spark, 50, "new").withColumn("b", F.when(F.col("k") == 49, F.raise_error(F.lit("stop"))).otherwise(F.col("b")))
    with pytest.raises(Exception, match="stop"):
        keyed.upsert(spark, str(path), bad, "k", SCHEMA, buckets=4)
    assert found(spark, path) == before


def test_filings_source(spark, tmp_path):
    for cik, forms in (("0000000320", ["10-K", "8-K", "10-K"]), ("0000000789", ["10-Q"]), ("0000000900", [])):
        recent = {"form": forms, "filingDate": [f"2024-01-0{k + 1}" for k in range(len(forms))], "accessionNumber": [f"a{k}" for k in range(len(forms))], "primaryDocument": ["d"]}
        (tmp_path / f"CIK{cik}.json").write_text(json.dumps({"name": f"Company {cik}", "filings": {"recent": recent}}))
    (tmp_path / "other.txt").write_text("no answer")
    spark.dataSource.register(filings_source.FilingsSource)
    load = lambda **options: spark.read.format("filings").options(**options).load(str(tmp_path))
    table, one = load(), load(cik="320", form="10-K")
    assert [(r["place"], r["accession"], r["document"], r["company"]) for r in one.orderBy("place").collect()] == [(0, "a0", "d", "Company 0000000320"), (2, "a2", "", "Company 0000000320")]
    assert table.where("cik = '0000000789'").count() == 1 and table.count() == 4 and table.select("cik").distinct().count() == 2
    assert one.rdd.getNumPartitions() == 1 and table.rdd.getNumPartitions() == 3
    assert load(form="10-Q, 8-K").count() == 2 and load(cik="1").count() == 0 and load(cik="789,0000000320").count() == 4
    assert [r["accession"] for r in ranking.top_k(table.where("form = '10-K'"), ["cik"], [F.asc("place")], 1).collect()] == ["a0"]
    raw = spark.createDataFrame([("320", ["a0", "a1", "a2"], ["10-K", "8-K", "10-K"], ["2024-01-01", "2024-01-02", "2024-01-03"], ["d", "", ""])], "cik string, accession array<string>, form array<string>, date array<string>, document array<string>")
    want = readers.filings(raw, "10-K", 10).select("cik", "accession", "form", "date", "document").collect()
    assert Counter(map(tuple, table.where("form = '10-K'").select("cik", "accession", "form", "date", "document").collect())) == Counter(map(tuple, want))
