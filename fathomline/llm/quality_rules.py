"""Quality rules on whole texts: word statistics and Zstandard compression bands."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import settle, small

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Bands:
    """Limits on compressed over plain bytes: fixed ones that no prose passes, and closer ones from the corpus itself, by length and script.

    ``whole``: rows (bytes from, least, most) in rising order, ``chunk``: least and most. For the others, lengths are in classes of half an octave; a class with under ``least`` different measures takes in
    its neighbours. Its limits lie ``fence`` times the distance of the quartiles beyond them, and
    ``margin`` from the median at least: text that compresses far better than most of its length is
    repetitive, far worse is noise. Chunks of ``chunk_bytes``, the last of them at the text's end, have
    limits of their own, and a text is rejected if over ``chunk_share`` of its chunks are outside.
    """

    whole: tuple[tuple[int, float, float], ...] = ((0, 0.0, 99.0), (200, 0.35, 0.95), (500, 0.33, 0.80), (1_000, 0.30, 0.72), (4_000, 0.27, 0.65), (16_000, 0.24, 0.62))
    chunk: tuple[float, float] = (0.25, 0.68)
    fence: float = 2.0
    margin: float = 0.04
    least: int = 100
    chunk_bytes: int = 4096
    chunk_share: float = 0.25
    level: int = 3


BANDS = Bands()


def repeated_words(words: list[str], width: int = 5) -> int:
    """How many words stand in a ``width``-word window that occurs twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) > len(words) - width:  # a repeated window repeats each of its words
        return 0
    window, have = ids, 1
    while have < width:  # number the windows of doubled width, then those of the full one
        step = min(have, width - have)
        pair = window[:-step] * (int(window.max()) + 1) + window[step:]
        window, have = np.unique(pair, return_inverse=True)[1], have + step
    twice = np.bincount(window)[window] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def text_stats(text: str) -> tuple[int, int, int, int, int]:
    """The values of STATS."""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def measures(data: bytes, pack, bands: Bands = BANDS) -> tuple[int, int, int, list[int]]:
    """Bytes, kind of script (0, 1, 2: few, some, many bytes beyond ASCII), and thousandths of the compressed
    size of the text and of each chunk. A text of up to a chunk is one chunk and is measured as a whole alone."""
    n, size = len(data), bands.chunk_bytes
    if not n:
        return 0, 0, 1000, []
    wide = int(np.count_nonzero(np.frombuffer(data, np.uint8) > 127)) / n
    starts = [*range(0, n - size, size), n - size] if n > size else []
    return n, (wide > 0.05) + (wide > 0.3), round(1000 * len(pack(data)) / n), [round(1000 * len(pack(data[k : k + size])) / size) for k in starts]


_FOUND = ["n_bytes", "script", "ratio", "chunks"]


def _measured(docs: DataFrame, text_col: str, bands: Bands) -> DataFrame:
    """``docs`` with STATS, base_failed and the measures as columns behind its own, whatever those are called."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=bands.level).compress
        for b in small(batches):
            texts = [t or "" for t in b.column(at).to_pylist()]
            stats = list(zip(*map(text_stats, texts), strict=True))
            failed = [w < 10 or 100 * r > 20 * w for w, r in zip(stats[0], stats[4], strict=True)]
            found = zip(*(measures(t.encode("utf-8", "replace"), pack, bands) for t in texts), strict=True)
            made = [*(pa.array(c, pa.int64()) for c in stats), pa.array(failed), *(pa.array(c, k) for c, k in zip(found, (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())), strict=True))]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*names, *(f"_{c}" for c in (*STATS, "base_failed", *_FOUND))])

    at, names = docs.columns.index(text_col), [f"c{k}" for k in range(len(docs.columns))]
    kinds = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True)]
    kinds += [*(f"_{c} long" for c in STATS), "_base_failed boolean", "_n_bytes long", "_script int", "_ratio int", "_chunks array<int>"]
    return docs.toDF(*names).mapInArrow(each, ", ".join(kinds))


def limits(counts: list[tuple[int, int, int]], bands: Bands = BANDS) -> dict[int, tuple[int, int]]:
    """Least and greatest measure of each class, from rows (class, measure, how often)."""
    classes = sorted({c for c, _, _ in counts})
    by = {c: sorted((m, n) for k, m, n in counts if k == c) for c in classes}
    out = {}
    for c in classes:
        near = sorted(classes, key=lambda k: (abs(k - c), k))
        taken, total = [], 0
        for k in near:
            if total >= bands.least:
                break
            taken += by[k]
            total += sum(n for _, n in by[k])
        taken.sort()
        ends = np.cumsum([n for _, n in taken])
        low, mid, high = (taken[int(np.searchsorted(ends, q * total))][0] for q in (0.25, 0.5, 0.75))
        far = bands.fence * (high - low)
        out[c] = int(min(low - far, mid - 1000 * bands.margin)), int(max(high + far, mid + 1000 * bands.margin))
    return out


def _judged(rows: DataFrame, found: DataFrame, bands: Bands) -> DataFrame:
    """``rows`` of ``_measured`` with ``_kept`` and ``_outside``, by the limits from the settled measures ``found``."""
    kind = F.floor(2 * F.log2(F.col("_n_bytes") + 1)).cast("int")
    rows, found = (df.withColumn("_class", 1000 * F.col("_script") + kind) for df in (rows, found))
    # Copies have one length and measure, and count once. Classes times thousandths come to the driver.
    good = found.where("not _base_failed")
    whole = good.select("_class", "_n_bytes", "_ratio").distinct().groupBy("_class", "_ratio").agg(F.count("*").alias("n")).collect()
    parts = good.select("_script", F.explode("_chunks").alias("m"), "_n_bytes").distinct().groupBy("_script", "m").agg(F.count("*").alias("n")).collect()
    spark = found.sparkSession
    by_script = [limits([tuple(r) for r in whole if r[0] // 1000 == k], bands) for k in range(3)]
    of_text = spark.createDataFrame([(c, *x) for one in by_script for c, x in one.items()], "_class int, _low int, _high int")
    of_chunk = spark.createDataFrame([(c, *x) for k in range(3) for c, x in limits([tuple(r) for r in parts if r[0] == k], bands).items()], "_script int, _chunk_low int, _chunk_high int")
    rows = rows.join(F.broadcast(of_text), "_class", "left").join(F.broadcast(of_chunk), "_script", "left")
    fixed = lambda k: F.coalesce(*[F.when(F.col("_n_bytes") >= x[0], F.lit(round(1000 * x[k]))) for x in reversed(bands.whole)])
    low, high = F.greatest("_low", fixed(1)), F.least("_high", fixed(2))  # nulls count for nothing
    chunk_low, chunk_high = F.greatest("_chunk_low", F.lit(round(1000 * bands.chunk[0]))), F.least("_chunk_high", F.lit(round(1000 * bands.chunk[1])))
    rows = rows.withColumn("_outside", F.size(F.filter("_chunks", lambda m: (m < chunk_low) | (m > chunk_high))).cast("long"))
    inside = F.col("_ratio").between(low, high)
    return rows.withColumn("_kept", ~F.col("_base_failed") & inside & (F.col("_outside") <= bands.chunk_share * F.size("_chunks")))


def quality_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands: Bands = BANDS) -> DataFrame:
    """One row for each input row: ``id``, STATS, base_failed, kept, ratio, n_chunks, n_chunks_outside.

    Texts are measured where they lie; only measures are counted. Null and empty texts have no words,
    and fail the base rules. The limits come from all texts that pass those, copies counted once; they
    don't depend on how rows are partitioned. Repeated rows, ties and null ids keep a row each; other
    columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = settle(_measured(rows, "text", bands).drop("c1"), "measures")
    rows = _judged(found, found, bands)
    return rows.select(F.col("c0").alias("id"), *[F.col(f"_{c}").alias(c) for c in STATS], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), (F.col("_ratio") / 1000).alias("ratio"), F.size("_chunks").cast("long").alias("n_chunks"), F.col("_outside").alias("n_chunks_outside"))


def keep_good(docs: DataFrame, *, text_col: str = "text", bands: Bands = BANDS) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the bands, with all their columns.

    Null and empty texts fail the base rules and go; repeated rows go or stay together. An empty table
    gives an empty result.
    """
    # Texts are measured again where they are kept: a table of measured texts would be as large as the input.
    found = settle(_measured(docs.select(F.col(text_col).alias("text")), "text", bands).drop("c0"), "measures")
    return _judged(_measured(docs, text_col, bands), found, bands).where("_kept").select(*[f"c{k}" for k in range(len(docs.columns))]).toDF(*docs.columns)
