"""Lexical retrieval: postings, token statistics, inverse document frequency, BM25, trigram search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import settle
from .ranking import top_k
from .vector import HELD_BYTES, Best, met

K1, B = 1.2, 0.75
#: What a section's score is multiplied by.
SECTION_BOOSTS = {"Risk Factors": 1.2, "MD&A": 1.3, "Business": 1.1, "Financial Statements": 1.0, "Q&A Session": 1.1, "Forward-Looking Statements": 1.15}


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``tokens``, ``doc_len``; no row moves."""
    return docs.select(F.col(id_col).alias("doc_id"), T.tokens(text_col).alias("tokens")).withColumn("doc_len", F.size("tokens").cast("long"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``term``, ``doc_id``, ``tf``: partial sums for each document before the shuffle."""
    return tokenized(docs, id_col, text_col).select("doc_id", F.explode("tokens").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def token_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``term``, ``df``, ``total_freq``.

    One pass: each document gives its tokens and, marked, its distinct ones, and both are counted by
    partial sums, so that a task sends a row for each term it has seen, not for each document.
    """
    marked = F.concat(F.transform("tokens", lambda t: F.struct(t.alias("term"), F.lit(0).alias("d"))), F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("d"))))
    rows = tokenized(docs, id_col, text_col).select(F.inline(marked))
    return rows.groupBy("term").agg(F.sum(F.col("d").cast("long")).alias("df"), F.sum((1 - F.col("d")).cast("long")).alias("total_freq"))


def idf(n: Column, df: Column) -> Column:
    """ln((N - df + 0.5) / (df + 0.5) + 1); 0 where a count is 0 or missing."""
    return F.when((n > 0) & (df > 0), F.log((n - df + 0.5) / (df + 0.5) + 1)).otherwise(F.lit(0.0))


def query_terms(queries: DataFrame, id_col: str, text_col: str, first: int | None = None) -> DataFrame:
    """``query_id``, ``term``: the distinct tokens, of the ``first`` ones if given."""
    words = T.tokens(text_col)
    return queries.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(F.slice(words, 1, first) if first else words)).alias("term"))


def bm25(docs: DataFrame, terms: DataFrame, *, mode: str = "or", id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """``query_id``, ``doc_id``, ``score`` for each document with a term of a query; with ``and``, all of its terms.

    Texts are tokenised once: the postings of query terms, and a row with each document's length, are kept
    as a table, before any shuffle where the terms are few enough for Spark to broadcast. A
    collection that is asked again and again is better kept as an index (operators.text_index).
    """
    found, whole = _asked_postings(docs, terms, id_col, text_col)
    return bm25_of(found, whole, terms, mode=mode, k1=k1, b=b)


def _asked_postings(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """A settled table of the postings of asked terms, and one row of totals."""
    rows = tokenized(docs, id_col, text_col)
    spots = F.concat(F.coalesce("tokens", F.array().cast("array<string>")), F.array(F.lit("")))  # no token is empty: that is the document's own row
    wanted = terms.select("term").distinct().unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term")))
    found = rows.select("doc_id", "doc_len", F.explode(spots).alias("term")).join(wanted, "term", "left_semi").groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"), F.sum("doc_len").alias("all_len"))
    found = settle(found, "hits")
    own = found.where("term = ''")
    whole = own.agg(F.sum("tf").alias("n_docs"), (F.sum("all_len") / F.sum(F.when(F.col("doc_len").isNotNull(), F.col("tf")))).alias("mean_len"))
    return found.where("term <> ''").drop("all_len"), whole


def bm25_top(docs: DataFrame, terms: DataFrame, k: int, *, mode: str = "or", id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B, **beside) -> DataFrame:
    """best(bm25(...), k) as a settled table, without a row for each document and query; ``beside``: as top_of() takes it."""
    found, whole = _asked_postings(docs, terms, id_col, text_col)
    return top_of(found, whole, terms, k, mode=mode, k1=k1, b=b, **beside)


#: Documents and (query, term) pairs of a block, and the numbers of a matrix of documents and terms.
DOCS, PAIRS, CELLS = 512, 16_384, 1 << 22


def top_of(hits: DataFrame, whole: DataFrame, terms: DataFrame, k: int, *, mode: str = "or", k1: float = K1, b: float = B, factors: DataFrame | None = None, owners: DataFrame | None = None, companies: DataFrame | None = None) -> DataFrame:
    """``query_id``, ``doc_id``, ``score``, ``rank``: the ``k`` best by bm25_of(), ties to the lesser document.

    A document's weights come together once; blocks of documents meet blocks of queries, scores are a
    matrix product of them, and a task hands on the best ``k`` of each query alone. ``factors`` (doc_id,
    factor) multiply the rounded scores before the cut. With ``owners`` (doc_id, company_id) and ``companies``
    (query_id, company_ids), queries that name companies have these' documents alone.
    """
    frequency = hits.groupBy("term").agg(F.count("*").alias("df"))
    numbered = settle(frequency.crossJoin(F.broadcast(whole)).withColumn("no", F.monotonically_increasing_id()), "terms")  # one row of totals
    tf, part = F.col("tf"), F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("mean_len"))
    weighed = hits.join(numbered, "term").select("doc_id", "no", (idf(F.col("n_docs"), F.col("df")) * tf * (k1 + 1) / part).alias("w"))
    by_doc = weighed.groupBy("doc_id").agg(F.collect_list(F.struct("no", "w")).alias("x"))  # the asked terms of one document
    by_doc = by_doc.withColumn("factor", F.lit(1.0)) if factors is None else by_doc.join(factors.select("doc_id", F.col("factor").cast("double")), "doc_id", "left").fillna(1.0, ["factor"])
    by_doc = by_doc.withColumn("owner", F.lit("")) if owners is None else by_doc.join(owners.select("doc_id", F.col("company_id").alias("owner")), "doc_id", "left").fillna("", ["owner"])
    by_doc = by_doc.select(F.col("doc_id").cast("long").alias("doc_id"), "factor", "owner", F.col("x.no").alias("nos"), F.col("x.w").alias("ws"))
    asked = terms.join(numbered.select("term", "no"), "term", "left").groupBy("query_id").agg(F.collect_list("no").alias("nos"), F.count("*").alias("asked"))
    asked = asked.withColumn("allowed", F.array().cast("array<string>")) if companies is None else asked.join(companies.select("query_id", F.col("company_ids").alias("allowed")), "query_id", "left")
    asked = asked.select(F.col("query_id").cast("long").alias("query_id"), "nos", "asked", F.coalesce("allowed", F.array().cast("array<string>")).alias("allowed"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                nos, ws = part.column("nos"), part.column("ws").flatten().to_numpy()
                columns = [part.column("doc_id").to_numpy(), part.column("factor").to_numpy(), nos.value_lengths().to_numpy().astype(np.int64), nos.flatten().to_numpy(), ws]
                yield pa.RecordBatch.from_arrays([*(pa.array([c.tobytes()]) for c in columns), pa.array([part.column("owner").to_pylist()], pa.list_(pa.string()))], ["ids", "factors", "sizes", "nos", "ws", "owners"])

    def question_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for r in [*batch.to_pylist(), None]:
                if rows and (r is None or held + len(r["nos"]) > PAIRS):
                    numbers = [np.array([x[c] for x in rows], np.int64) for c in ("query_id", "asked")] + [np.array([len(x["nos"]) for x in rows], np.int64), np.array([n for x in rows for n in x["nos"]], np.int64)]
                    yield pa.RecordBatch.from_arrays([*(pa.array([c.tobytes()]) for c in numbers), pa.array([[x["allowed"] for x in rows]], pa.list_(pa.list_(pa.string())))], ["q_ids", "asked", "q_sizes", "q_nos", "allowed"])
                    rows, held = [], 0
                if r is not None:
                    rows.append(r)
                    held += len(r["nos"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                q_ids, want, q_sizes, q_nos, ids, sizes, nos = (np.frombuffer(r[c], np.int64) for c in ("q_ids", "asked", "q_sizes", "q_nos", "ids", "sizes", "nos"))
                ws, factors_ = np.frombuffer(r["ws"]), np.frombuffer(r["factors"])
                known = np.unique(q_nos)
                if not len(known):
                    continue
                spot = np.minimum(np.searchsorted(known, nos), len(known) - 1)
                good, row = known[spot] == nos, np.repeat(np.arange(len(ids)), sizes)
                held = np.zeros((len(known), len(q_ids)))
                held[np.searchsorted(known, q_nos), np.repeat(np.arange(len(q_ids)), q_sizes)] = 1
                names, owner = np.unique(np.array(r["owners"], object).astype(str), return_inverse=True)
                barred = np.array([np.isin(names, a, invert=True) if a else np.zeros(len(names), bool) for a in r["allowed"]])
                step = max(1, CELLS // len(known))
                for lo in range(0, len(ids), step):
                    mine = good & (row >= lo) & (row < lo + step)
                    w = np.zeros((min(step, len(ids) - lo), len(known)))
                    w[row[mine] - lo, spot[mine]] = ws[mine]
                    s = (w @ held).T
                    no = s <= 0 if mode == "or" else ((w > 0).astype(float) @ held).T < want[:, None] - 0.5
                    s = np.round(s, 6)
                    f = factors_[lo : lo + step]
                    if (f != 1).any():
                        s = np.round(s * f, 6)
                    s[no | barred[:, owner[lo : lo + step]]] = -np.inf
                    best.put(q_ids, ids[lo : lo + step], s)
                if best.size > HELD_BYTES:
                    yield from best.drain("doc_id")
        yield from best.drain("doc_id")

    a = settle(asked.mapInArrow(question_blocks, "q_ids binary, asked binary, q_sizes binary, q_nos binary, allowed array<array<string>>"), "question-blocks", small=True)
    rows = by_doc.mapInArrow(blocks, "ids binary, factors binary, sizes binary, nos binary, ws binary, owners array<string>")
    found = settle(met(rows, a, "q_nos", "q_ids").mapInArrow(each, "query_id long, doc_id long, score double"), "best", small=True)
    return settle(top_k(found, ["query_id"], [F.desc("score"), F.asc("doc_id")], k), "top")


#: Items in a broadcast at most; more are joined by a shuffle.
ITEMS = 500_000


def item_terms(docs: DataFrame, items: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``item``, ``term``: the distinct asked terms that the given items (item) hold; no other text is tokenised."""
    kept = settle(items.select("item").distinct(), "items")
    kept = F.broadcast(kept) if kept.count() <= ITEMS else kept
    rows = tokenized(docs.join(kept, docs[id_col] == kept["item"], "left_semi"), id_col, text_col)
    found = rows.select(F.col("doc_id").alias("item"), F.explode(F.array_distinct("tokens")).alias("term"))
    return settle(found.join(terms.select("term").distinct(), "term", "left_semi"), "item-terms")


def bm25_of(hits: DataFrame, whole: DataFrame, terms: DataFrame, *, mode: str = "or", k1: float = K1, b: float = B) -> DataFrame:
    """Scores of hits (term, doc_id, tf, doc_len), all of them for each term, in a collection with totals ``whole`` (n_docs, mean_len)."""
    frequency = hits.groupBy("term").agg(F.count("*").alias("df"))
    weighed = hits.join(frequency, "term").crossJoin(F.broadcast(whole))  # one row of totals
    tf, part = F.col("tf"), F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("mean_len"))
    weighed = weighed.select("term", "doc_id", (idf(F.col("n_docs"), F.col("df")) * tf * (k1 + 1) / part).alias("part"))
    scored = weighed.join(terms, "term").groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"), F.count("*").alias("n_terms"))
    if mode == "and":
        scored = scored.join(terms.groupBy("query_id").agg(F.count("*").alias("asked")), "query_id").where("n_terms = asked").drop("asked")
    return scored.select("query_id", "doc_id", F.round("score", 6).alias("score"))


def matching(docs: DataFrame, **wanted: str | None) -> DataFrame:
    """Documents whose columns equal what is ``wanted`` (company, type, language, ...), all of it; None asks for nothing.

    Before the scoring, so that the filters reach the scan and the counts are those of the rest.
    """
    for column, value in wanted.items():
        docs = docs if value is None else docs.where(F.col(column) == value)
    return docs


def best(scored: DataFrame, k: int, score: str = "score", item: str = "doc_id") -> DataFrame:
    """The top ``k`` of each query, with ``rank``; ties go to the lesser item."""
    return top_k(scored, ["query_id"], [F.desc(score), F.asc(item)], k)


def boosted(scored: DataFrame, section: str, boosts: dict[str, float] = SECTION_BOOSTS) -> DataFrame:
    """Scores times their section's boost, 1 where it has none."""
    table = F.create_map(*[F.lit(x) for pair in boosts.items() for x in pair])
    return scored.withColumn("score", F.round(F.col("score") * F.coalesce(F.element_at(table, F.col(section)), F.lit(1.0)), 6))


def _gram_sets(df: DataFrame, col: str) -> DataFrame:
    """``value``, ``grams`` (distinct), ``n`` of the distinct values."""
    rows = df.select(F.col(col).alias("value")).distinct().select("value", T.trigrams("value").alias("grams"))
    return rows.where("value is not null").withColumn("n", F.size("grams"))


def _rare_first(sets: DataFrame, ranks: DataFrame) -> DataFrame:
    """The sets with their grams as numbers, the rarest first."""
    rows = sets.select("value", "n", F.explode("grams").alias("gram")).join(ranks, "gram")
    return rows.groupBy("value", "n").agg(F.sort_array(F.collect_list("no")).alias("nos"))  # the grams of one value


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``a``, ``b`` (and the sets as ``xs``, ``ys``) of sets (value, n, nos) that may reach a Jaccard similarity of ``least``.

    Of two sets that do, the prefixes of n - ceil(least * n) + 1 rarest members meet. A pair is kept at
    its first common member only, and only if what is left behind it can hold the overlap that the
    sizes demand.
    """
    size = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1
    prefix = lambda df, v, n, s, p: df.select(F.col("value").alias(v), F.col("n").alias(n), F.col("nos").alias(s), F.posexplode(F.slice("nos", F.lit(1), size.cast("int"))).alias(p, "no"))
    met = prefix(left, "a", "na", "xs", "i").join(prefix(right, "b", "nb", "ys", "j"), "no")
    met = met.where((F.col("na") >= least * F.col("nb") - 1e-9) & (F.col("nb") >= least * F.col("na") - 1e-9))
    behind = F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j"))
    met = met.where(behind >= F.lit(least / (1 + least)) * (F.col("na") + F.col("nb")) - 1e-9)
    first = F.size(F.array_intersect(F.slice("xs", F.lit(1), F.col("i")), F.slice("ys", F.lit(1), F.col("j")))) == 0
    return met.where(first).select("a", "b", "xs", "ys")


def similar_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``a``, ``b``, ``sim`` >= ``least`` (at six decimals) for sets (value, n, grams): a join on prefixes of rare members.

    No common member pairs all with all: members are numbered by rarity over both sides, and only the
    rarest of each set, as many as ``least`` demands, are joined on.
    """
    both = left.select(F.explode("grams").alias("gram")).unionByName(right.select(F.explode("grams").alias("gram")))
    ranks = settle(both.groupBy("gram").agg(F.count("*").alias("f")).select("gram", F.struct("f", "gram").alias("no")), "ranks")
    pairs = candidates(_rare_first(left, ranks), _rare_first(right, ranks), max(0.0, least - 1e-6))
    shared = F.size(F.array_intersect("xs", "ys"))
    sim = shared / (F.size("xs") + F.size("ys") - shared).cast("double")
    return pairs.select("a", "b", F.round(sim, 6).alias("sim")).where(F.col("sim") >= least)


def trigram_pairs(left: DataFrame, right: DataFrame, left_col: str, right_col: str, least: float) -> DataFrame:
    """``left_col``, ``right_col``, ``sim`` >= ``least`` for distinct values, by shared over all distinct trigrams."""
    found = similar_sets(_gram_sets(left, left_col), _gram_sets(right, right_col), least)
    return found.select(F.col("a").alias(left_col), F.col("b").alias(right_col), "sim")


def with_trigrams(scored: DataFrame, docs: DataFrame, mentions: DataFrame, *, weight: float = 0.5, k: int = 100, id_col: str = "doc_id", name_col: str = "name", least: float = 0.3) -> DataFrame:
    """Hits of bm25() and, behind them, documents whose ``name_col`` resembles a mention (query_id, mention).

    The latter score ``weight`` times their similarity and count only where the query doesn't have
    the document yet; then both are cut at ``k``.
    """
    near = trigram_pairs(mentions, docs.select(name_col), "mention", name_col, least)
    found = mentions.join(near, "mention").join(docs.select(F.col(id_col).alias("doc_id"), name_col), name_col)
    found = found.groupBy("query_id", "doc_id").agg(F.round(F.max("sim") * weight, 6).alias("score"))
    return best(scored.unionByName(found.join(scored, ["query_id", "doc_id"], "left_anti").select(*scored.columns)), k)


#: Tables and columns that a trigram search may name.
SEARCHABLE = {"chunks": ("text", "section"), "lexicon_entries": ("surface_form", "canonical_label"), "ticker_mappings": ("ticker", "company_name")}


def searchable(table: str, column: str) -> str:
    """The column, if a search may name it."""
    if column not in SEARCHABLE.get(table, ()):
        raise ValueError(f"{table}.{column} can't be searched")
    return column


def one_company(hits: DataFrame, companies: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits of queries that resolve to just one company (query_id, company_id), of that company's documents; of other queries, all."""
    single = companies.groupBy("query_id").agg(F.countDistinct("company_id").alias("n"), F.first("company_id").alias("only")).where("n = 1").select("query_id", "only")
    rows = hits.join(single, "query_id", "left").join(docs.select("doc_id", "company_id"), "doc_id", "left")
    return rows.where(F.col("only").isNull() | (F.col("only") == F.col("company_id"))).select(*hits.columns)


def of_companies(hits: DataFrame, companies: DataFrame, docs: DataFrame, item: str = "doc_id") -> DataFrame:
    """Hits of queries that name companies (query_id, company_ids), of those companies' documents (``item``, company_id); of other queries, all."""
    named = companies.where(F.size("company_ids") > 0).select("query_id", "company_ids")
    rows = hits.join(named, "query_id", "left").join(docs.select(item, "company_id"), item, "left")
    return rows.where(F.col("company_ids").isNull() | F.array_contains("company_ids", F.coalesce("company_id", F.lit("")))).select(*hits.columns)
