"""Column functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from fathomline.functions import numbers as N
from fathomline.functions import text as T
from fathomline.functions import vectors as V


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("word", "stem"), [("is", "is"), ("cats", "cat"), ("organization", "organize"), ("quickly", "quick"), ("parties", "party"), ("testing", "test"), ("ably", "ably"), ("sing", "sing")])
def test_stem(spark, word, stem):
    assert one(spark, T.stem("w"), w=word) == stem


def test_cleaning(spark):
    assert one(spark, T.clean_text("t"), t=" a\tb  c\r\nd\x01 ") == "a b c\nd"
    assert one(spark, T.normalize_text("t"), t="a–b  c​…\n\n\n\nd\x02") == "a-b c...\n\nd"
    assert one(spark, T.control_characters("t"), t="a\x02b\nc") == 1
    assert one(spark, T.fold_case("t"), t="The EBITDA of (AAPL), Ünder REALLYLONG") == "the EBITDA of (AAPL), ünder reallylong"
    assert one(spark, T.nfc(F.col("t")), t="é") == "é"
    assert one(spark, T.normalize_metric_name("t"), t="EBITDA (adj.) 1.5") == "ebitda adj 1.5"
    assert one(spark, T.normalize_identifier("t"), t=" [brk.b] ") == "BRK.B"


def test_tokens(spark):
    assert one(spark, T.tokens("t"), t="Éon's M&A, P/E 42!") == ["éon", "s", "m&a", "p/e", "42"]
    assert one(spark, T.schema_tokens("t"), t=" us-gaap:Net_Income/Loss ") == ["us", "gaap", "net", "income", "loss"]
    assert one(spark, T.identifier_tokens("t"), t="buy AAPL or BRK.B now") == ["AAPL", "BRK.B"]
    assert one(spark, T.ngrams(T.words("t"), 2), t="a b c") == ["a b", "b c"]
    assert one(spark, T.ngrams(T.words("t"), 3), t="a b") == []
    assert one(spark, T.token_estimate("t"), t="a b c d") == 5
    assert [one(spark, T.token_kind("t"), t=x) for x in ("eps", "12", "word")] == ["identifier", "number", "narrative"]


def test_trigrams(spark):
    assert set(one(spark, T.trigrams("t"), t="ab")) == {"  a", " ab", "ab "}
    assert one(spark, T.trigram_similarity("a", "b"), a="abc", b="abd") == pytest.approx(2 / 6)
    assert one(spark, T.trigram_similarity("a", "b"), a="Same", b="same") == 1.0


def test_periods(spark):
    found = one(spark, T.periods("t"), t="FY 2023, Q3'24 and 2Q25, last quarter, TTM YoY")
    assert [(p["kind"], p["label"]) for p in found] == [("FY", "FY2023"), ("Q", "Q3 2024"), ("Q", "Q2 2025"), ("CY", "2023"), ("REL", "LAST QUARTER"), ("REL", "TTM"), ("COMP", "YOY")]


def test_cues(spark):
    assert one(spark, T.comparison("t"), t="MSFT versus AAPL trend") == "compare"
    assert one(spark, T.comparison("t"), t="plain") is None
    assert one(spark, T.has_negation("t"), t="excluding debt") is True
    assert one(spark, T.metric_mentions(F.split("t", " ")), t="net of cash") == ["net", "cash"]


def test_numbers(spark):
    assert one(spark, N.ratio("a", "b"), a=1.0, b=0.0) is None
    assert [one(spark, N.money("a"), a=x) for x in (2.5e9, -3.2e6, 1500.0, 12.0)] == ["$2.5B", "$-3.2M", "$1.5K", "$12"]
    assert one(spark, N.percent("a"), a=0.123) == "12.3%"
    assert one(spark, N.bar("a"), a=5.0) == "#" * 10 + "." * 10
    assert one(spark, N.padded_id("a"), a="0032019") == "0000032019"
    assert [one(spark, N.grade("a"), a=x) for x in (9.5, 4.2, -1.0)] == ["A+", "C", "F"]


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(c)) for c in x])
    assert one(spark, V.cosine(v(1, 0), v(1, 1))) == pytest.approx(2**-0.5)
    assert one(spark, V.cosine(v(0, 0), v(1, 1))) == 0.0
    assert one(spark, V.cosine(v(1), v(1, 1))) == 0.0
    assert one(spark, V.negative_distance(v(0, 3), v(4, 0))) == -5.0
    assert one(spark, V.truncated(v(3, 4, 9), 2)) == pytest.approx([0.6, 0.8])
    assert one(spark, V.truncated(v(3, 4), 2)) == [3.0, 4.0]
