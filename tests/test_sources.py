"""Readers and writers on files of their formats."""

import json

from pyspark.sql import functions as F

from fathomline.sources import readers, sinks


def test_companies(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps([{"name": "A", "ticker": "AAA", "cik": "12"}, {"canonical_id": "b", "name": "B", "country": "DE", "aliases": ["Bee"]}]))
    rows = {r["company_id"]: r for r in readers.read_companies(spark, str(path)).withColumn("t", readers.primary_ticker(F.col("identifiers"))).collect()}
    assert rows["AAA"]["country"] == "US" and rows["AAA"]["t"] == "AAA" and [i["id_type"] for i in rows["AAA"]["identifiers"]] == ["ticker", "cik"]
    assert rows["b"]["aliases"] == ["Bee"] and rows["b"]["t"] is None


def test_statements(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"2023": {"income_statement": {"revenue": 5.0}, "cash_flow": {"capex": -1.0}}, "2024": {"income_statement": {"revenue": 6.0}}}))
    rows = sorted((r["year"], r["metric"], r["value"]) for r in readers.read_statements(spark, str(tmp_path / "f.json"), "x").collect())
    assert rows == [(2023, "capex", -1.0), (2023, "revenue", 5.0), (2024, "revenue", 6.0)]


def test_metrics_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("period,metric,value\n2023,revenue,10\n2023,cost,bad\n2024,cost,3\n")
    rows = readers.read_metrics_csv(spark, str(tmp_path / "m.csv"), "x", ["revenue", "cost"]).collect()
    assert [(r["period"], r["revenue"], r["cost"]) for r in rows] == [("2023", 10.0, None)]


def test_folder_skips_broken_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"name": "A"}, {"name": "B"}]')
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.txt").write_text('{"name": "C"}')
    rows = readers.read_folder(spark, str(tmp_path), "name string").where("name is not null").collect()
    assert sorted((r["name"], r["file"]) for r in rows) == [("A", "a.json"), ("B", "a.json")]


def test_lexicon(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"version": "v2", "entries": [{"surface_form": "rev", "canonical_id": "m", "confidence": 0.5}], "tickers": [{"ticker": "AAA", "variants": ["AA"]}], "abbreviations": [], "schema_mappings": [{"surface_form": "x", "concept": "y"}]}))
    tables = readers.read_lexicon(spark, str(tmp_path / "l.json"))
    assert {k: v.count() for k, v in tables.items()} == {"entries": 1, "tickers": 1, "abbreviations": 0, "schema_mappings": 1}
    assert tables["entries"].first()["version"] == "v2"


def test_texts_and_judgments(spark, tmp_path):
    (tmp_path / "d1.txt").write_text("a\nb")
    assert tuple(readers.read_texts(spark, str(tmp_path / "d1.txt")).first()) == ("d1", "a\nb")
    (tmp_path / "q.tsv").write_text("q1\tone\nbad\nq2\ttwo\n")
    (tmp_path / "r.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\nq9\td1\t1\nq2\td2\tx\n")
    queries, rels = readers.read_judgments(spark, str(tmp_path / "q.tsv"), str(tmp_path / "r.tsv"))
    assert queries.count() == 2 and [tuple(r) for r in rels.collect()] == [("q1", "d1", 2)]


def test_filings(spark):
    raw = spark.createDataFrame([("320", ["a", "b", "c"], ["10-K", "8-K", "10-K"], ["1", "2", "3"], ["x", "y", "z"])], "cik string, accession array<string>, form array<string>, date array<string>, document array<string>")
    assert [(r["cik"], r["accession"]) for r in readers.filings(raw, "10-K", 1).collect()] == [("0000000320", "a")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert {r["k"]: r["json"] for r in sinks.json_rows(df, "k").collect()} == {1: '{"k":1,"v":"a"}', 2: '{"k":2}'}
    assert sinks.write_csv(df, str(tmp_path / "c")) and not sinks.write_csv(df.limit(0), str(tmp_path / "e"))
    assert readers.read_csv(spark, str(tmp_path / "c"), ["k", "v"]).count() == 2
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.append(df, str(tmp_path / "p"))
    sinks.append(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
