"""A kept inverted index: postings with positions, written once in segments, read by the terms asked for.

Layout of the folder of an index (a generation of it; registries tell which one is active):

* ``postings/segment=S/bucket=B``: term, doc_id, doc_len, tf, positions; ``bucket`` is a hash of the term,
  so a question reads the buckets of its terms alone
* ``documents/segment=S``: doc_id, doc_len
* ``gone/segment=S``: doc_ids of earlier segments that segment S replaces or removes
* ``counts/segment=S``: one row with the change in documents and their total length. It is written last: a
  segment counts only if it is there, so a job that fails half-way changes nothing.

The number of buckets is part of the counts, so that readers need no parameter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import lookup, settle
from . import lexical

BUCKETS = 64
_KINDS = {
    "postings": "term string, doc_id long, doc_len long, tf long, positions array<int>, segment int, bucket int",
    "documents": "doc_id long, doc_len long, segment int",
    "gone": "doc_id long, segment int",
    "counts": "n_docs long, n_texts long, total_len long, buckets int, base boolean, segment int",
}


def plain(text: Column) -> Column:
    """All tokens, in order."""
    return T.tokens(text)


def english(text: Column) -> Column:
    """Stems of all tokens, in order; stop words leave a null behind, so that places stay."""
    return F.transform(T.tokens(text), lambda w: F.when(~w.isin(*T.STOP_WORDS), T.stem(w)))


def _table(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    try:
        return spark.read.schema(_KINDS[kind]).parquet(f"{path}/{kind}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            return None
        raise


def _segments(spark: SparkSession, path: str) -> list:
    """The counts of the segments that are whole and not merged into a later one: a row each."""
    counts = _table(spark, path, "counts")
    rows = sorted(counts.collect(), key=lambda r: r["segment"]) if counts is not None else []
    base = max((k for k, r in enumerate(rows) if r["base"]), default=0)
    return rows[base:]


def _bucket(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


#: Analyzers that give a word or a null for each token: a document's length comes from its tokens alone.
_LENGTHS = {english: plain}


def add_segment(docs: DataFrame, path: str, *, terms: DataFrame | None = None, removed: DataFrame | None = None, analyzer: Callable[[Column], Column] = plain, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> int:
    """Write ``docs`` as a further segment and return its number.

    Ids are unique within ``docs``; those that the index has already are replaced, and those of
    ``removed`` (doc_id) leave it. Texts are tokenised once; a frequent term's bucket is split over several
    tasks and files. A null text has no terms and counts as a document, but not for the mean length.
    With ``terms`` (term) the segment holds these terms' postings alone, of all documents: others' are
    dropped before they are grouped and shuffled. Documents and lengths are whole.
    """
    spark, have = docs.sparkSession, _segments(docs.sparkSession, path)
    every = _table(spark, path, "counts")
    number = 1 + max((r["segment"] for r in every.select("segment").collect()), default=0) if every is not None else 1
    buckets = have[0]["buckets"] if have else buckets
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), analyzer(F.col(text_col)).alias("words")).withColumn("doc_len", F.size("words").cast("long"))
    rows = words.select("doc_id", "doc_len", F.posexplode("words").alias("at", "term")).where("term is not null")
    if terms is not None:
        rows = rows.join(lookup(terms.select("term").distinct(), "asked-terms"), "term", "left_semi")
    rows = rows.groupBy("doc_id", "term").agg(F.sort_array(F.collect_list("at")).alias("positions"), F.first("doc_len").alias("doc_len"))
    rows = rows.select("term", "doc_id", "doc_len", F.size("positions").cast("long").alias("tf"), "positions", _bucket("term", buckets).alias("bucket"))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "doc_id").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings/segment={number}")
    lengths = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.size(_LENGTHS.get(analyzer, analyzer)(F.col(text_col))).cast("long").alias("doc_len"))
    lengths.write.mode("overwrite").parquet(f"{path}/documents/segment={number}")
    new = spark.read.schema("doc_id long, doc_len long").parquet(f"{path}/documents/segment={number}")
    n, texts, length = _sums(new)
    if have:
        out = new.select("doc_id") if removed is None else new.select("doc_id").unionByName(removed.select(F.col("doc_id").cast("long").alias("doc_id"))).distinct()
        old = live_documents(spark, path).join(out, "doc_id", "left_semi")
        old.write.mode("overwrite").parquet(f"{path}/gone/segment={number}")
        n, texts, length = (a - b for a, b in zip((n, texts, length), _sums(spark.read.schema("doc_id long, doc_len long").parquet(f"{path}/gone/segment={number}")), strict=True))
    _count(spark, path, number, (n, texts, length), buckets, base=not have)
    return number


def _sums(rows: DataFrame) -> tuple[int, int, int]:
    """Documents, those with a text, and their length."""
    r = rows.agg(F.count("*"), F.count("doc_len"), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
    return r[0], r[1], r[2]


def _count(spark: SparkSession, path: str, number: int, sums: tuple[int, int, int], buckets: int, base: bool) -> None:
    row = spark.createDataFrame([(*sums, buckets, base)], "n_docs long, n_texts long, total_len long, buckets int, base boolean")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/segment={number}")


def _live(rows: DataFrame, spark: SparkSession, path: str, segments: list) -> DataFrame:
    """Of rows (doc_id, segment) those that no later segment replaces."""
    gone = _table(spark, path, "gone")
    if len(segments) < 2 or gone is None:
        return rows
    gone = gone.where(F.col("segment").isin([r["segment"] for r in segments])).select(F.col("doc_id").alias("_gone"), F.col("segment").alias("_since"))
    return rows.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.col("segment") < F.col("_since")), "left_anti")


def live_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``doc_len`` of all documents that the index holds."""
    segments = _segments(spark, path)
    rows = _table(spark, path, "documents").where(F.col("segment").isin([r["segment"] for r in segments]))
    return _live(rows, spark, path, segments).select("doc_id", "doc_len")


def live_postings(spark: SparkSession, path: str, terms: DataFrame | None = None) -> DataFrame:
    """``term``, ``doc_id``, ``doc_len``, ``tf``, ``positions``; of the given terms, only their buckets are read.

    The numbers of the buckets, at most as many as there are, come to the driver.
    """
    segments = _segments(spark, path)
    rows = _table(spark, path, "postings").where(F.col("segment").isin([r["segment"] for r in segments]))
    if terms is not None:
        terms = terms.select("term").distinct()
        asked = [r[0] for r in terms.select(_bucket("term", segments[0]["buckets"])).distinct().collect()] if segments else []
        rows = rows.where(F.col("bucket").isin(asked) if asked else F.lit(False)).join(terms, "term", "left_semi")
    return _live(rows, spark, path, segments).select("term", "doc_id", "doc_len", "tf", "positions")


def totals(spark: SparkSession, path: str) -> DataFrame:
    """One row: ``n_docs``, ``mean_len``, from the counts of the segments."""
    rows = _segments(spark, path)
    n, texts, length = (sum(r[c] for r in rows) for c in ("n_docs", "n_texts", "total_len"))
    return spark.createDataFrame([(n, length / texts if texts else None)], "n_docs long, mean_len double")


def token_stats(spark: SparkSession, path: str) -> DataFrame:
    """``term``, ``df``, ``total_freq`` over all segments; as lexical.token_stats(), from the postings."""
    return live_postings(spark, path).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_freq"))


def bm25(spark: SparkSession, path: str, terms: DataFrame, *, mode: str = "or", k1: float = lexical.K1, b: float = lexical.B) -> DataFrame:
    """As lexical.bm25(), from the index: ``query_id``, ``doc_id``, ``score`` for the terms (query_id, term)."""
    return lexical.bm25_of(live_postings(spark, path, terms).drop("positions"), totals(spark, path), terms, mode=mode, k1=k1, b=b)


def bm25_top(spark: SparkSession, path: str, terms: DataFrame, k: int, *, mode: str = "or", k1: float = lexical.K1, b: float = lexical.B) -> DataFrame:
    """As lexical.bm25_top(), from the index."""
    hits = settle(live_postings(spark, path, terms).drop("positions"), "hits")
    return lexical.top_of(hits, totals(spark, path), terms, k, mode=mode, k1=k1, b=b)


def covers(spark: SparkSession, path: str, terms: DataFrame, *, weight: float = 0.1) -> DataFrame:
    """``query_id``, ``doc_id``, ``score``, ``n_covers``: documents with all terms of a query (query_id, term), by cover density.

    A cover is a smallest run of the text that holds all terms; each gives ``weight`` over one more than
    the words in it that aren't asked for. The places of the asked terms of one document and query
    are merged and swept once: a cover ends where the earliest of the terms' last places moves on.
    """
    numbered = terms.groupBy("query_id").agg(F.sort_array(F.collect_set("term")).alias("all"))  # the words of a question
    each = numbered.select("query_id", F.size("all").alias("asked"), F.posexplode("all").alias("no", "term"))
    hits = live_postings(spark, path, terms).join(each, "term")
    found = hits.groupBy("query_id", "doc_id").agg(F.first("asked").alias("asked"), F.count("*").alias("n"), F.collect_list(F.struct("no", "positions")).alias("held")).where("n = asked")
    spots = F.flatten(F.transform("held", lambda h: F.transform(h["positions"], lambda p: F.struct(p.alias("at"), h["no"].alias("no")))))
    found = found.select("query_id", "doc_id", "asked", F.array_sort(spots).alias("e"))
    start = F.struct(F.array_repeat(F.lit(0), F.col("asked")).alias("last"), F.lit(0).alias("low"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, i: Column) -> Column:
        at = F.element_at("e", i)
        last = F.transform(s["last"], lambda x, j: F.when(j == at["no"], i).otherwise(x))
        low = F.array_min(last)
        noise = at["at"] - F.element_at("e", F.greatest(low, F.lit(1)))["at"] - (i - low)
        new = low > s["low"]
        return F.struct(last.alias("last"), F.greatest(low, s["low"]).alias("low"), (s["score"] + F.when(new, F.lit(weight) / (1 + noise)).otherwise(0.0)).alias("score"), (s["n"] + new.cast("long")).alias("n"))

    swept = found.select("query_id", "doc_id", F.aggregate(F.sequence(F.lit(1), F.size("e")), start, step).alias("s"))
    return swept.select("query_id", "doc_id", F.round("s.score", 6).alias("score"), F.col("s.n").alias("n_covers"))


def compact(spark: SparkSession, path: str) -> int:
    """All live documents as one new segment, which readers use instead of those before; returns its number.

    Old folders stay for readers that began before; whoever knows that none is left may delete them.
    """
    segments = _segments(spark, path)
    number = max(r["segment"] for r in _table(spark, path, "counts").collect()) + 1
    buckets = segments[0]["buckets"]
    live_postings(spark, path).withColumn("bucket", _bucket("term", buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "doc_id").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings/segment={number}")
    live_documents(spark, path).write.mode("overwrite").parquet(f"{path}/documents/segment={number}")
    _count(spark, path, number, tuple(sum(r[c] for r in segments) for c in ("n_docs", "n_texts", "total_len")), buckets, base=True)
    return number
