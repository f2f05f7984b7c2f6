"""A quality classifier as a sparse rule ensemble.

A forest of trees over text statistics gives conjunctive rules, one for each path from the root; a
logistic regression with a lasso penalty keeps few of them; those become one Spark column expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_sample
from .scratch import settle, small

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STATS = (
    "log_words",
    "log_chars",
    "chars_per_word",
    "upper_share",
    "digit_share",
    "mark_share",
    "bang_share",
    "pipe_share",
    "symbol_share",
    "space_share",
    "wide_share",
    "distinct_words",
    "equal_neighbours",
    "commonest_word",
    "words_per_line",
    "distinct_lines",
    "sentence_ends",
)


def text_stats(text: str) -> np.ndarray:
    """The values of STATS; 0 for a text without words but for its length."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    by = np.bincount(data, minlength=256)
    words = WORD.findall(text)
    n, chars = max(1, len(words)), max(1, len(data))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x]
    of = lambda marks: sum(int(by[ord(c)]) for c in marks)
    letters = max(1, int(by[65:91].sum() + by[97:123].sum()))
    return np.array([
        np.log1p(len(words)),
        np.log1p(len(data)),
        len(data) / n,
        by[65:91].sum() / letters,
        by[48:58].sum() / chars,
        of("!\"'(),-.:;?") / n,
        of("!") / n,
        of("|") / n,
        of("#*$%&<>") / n,
        of(" \t\n\r") / chars,
        by[128:].sum() / chars,
        len(counts) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        max(counts.values(), default=0) / n,
        len(words) / max(1, len(lines)),
        len(set(lines)) / max(1, len(lines)),
        of(".?!") / n,
    ])


@dataclass(frozen=True)
class Rules:
    """``sample`` labelled rows at most train ``trees`` of ``depth``; all their rules go into the
    regression, and the lasso ``penalty`` chooses among them."""

    sample: int = 20_000
    trees: int = 24
    depth: int = 4
    penalty: float = 0.001
    seed: int = 17


RULES = Rules()
#: (number of the statistic, threshold, whether it lies above the threshold)
Condition = tuple[int, float, bool]


def paths(debug: str) -> set[tuple[Condition, ...]]:
    """The conjunctions of all paths, of every length, in the printed form of an ensemble's trees."""
    found, stack = set(), []
    for line in debug.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, (int(m[2]), float(m[4]), m[3] == ">")))
        low: dict[tuple[int, bool], float] = {}
        for _, (k, t, above) in stack:  # of conditions on one statistic, the tightest holds
            low[k, above] = (max if above else min)(t, low.get((k, above), t))
        found.add(tuple(sorted((k, t, above) for (k, above), t in low.items())))
    return found


def compiled(rule: tuple[Condition, ...], at: list[Column]) -> Column:
    """The conjunction as a column."""
    out = F.lit(True)
    for k, t, above in rule:
        out = out & (at[k] > F.lit(t) if above else at[k] <= F.lit(t))
    return out


@dataclass
class Ensemble:
    """``start`` plus the weights of the rules that hold: the log odds of good quality."""

    start: float
    rules: list[tuple[float, tuple[Condition, ...]]]

    def score(self, at: list[Column]) -> Column:
        odds = F.lit(self.start)
        for w, rule in self.rules:
            odds = odds + F.when(compiled(rule, at), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-odds))

    def text(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{STATS[k]} {'>' if above else '<='} {t:.4g}" for k, t, above in rule) for w, rule in self.rules]


def stat_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``stats`` of each row; a null text counts as empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            stats = [text_stats(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(stats, pa.list_(pa.float64()))], ["id", "stats"])

    return rows.mapInArrow(each, f"id {rows.schema['id'].dataType.simpleString()}, stats array<double>")


def fit(stats: DataFrame, labels: DataFrame, rules: Rules = RULES) -> Ensemble:
    """Learn from ``labels`` (key, label) on their rows of ``stats``. One class alone gives no rule."""
    train = settle(stats.join(F.broadcast(labels), stats["id"] == labels["key"]).select("stats", F.col("label").cast("double").alias("label")), "training")
    told = train.agg(F.count("*").alias("n"), F.sum("label").alias("k")).first()
    n, k = told["n"], told["k"] or 0.0
    if k in (0, n):
        p = (k + 1) / (n + 2)
        return Ensemble(float(np.log(p / (1 - p))), [])
    forest = RandomForestClassifier(featuresCol="x", numTrees=rules.trees, maxDepth=rules.depth, minInstancesPerNode=max(2, n // 2000), featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=rules.seed)
    trees = forest.fit(train.select(array_to_vector("stats").alias("x"), "label"))
    found = sorted(paths(trees.toDebugString))
    at = [F.element_at("stats", k + 1) for k in range(len(STATS))]
    held = train.select("label", array_to_vector(F.array(*[compiled(r, at).cast("double") for r in found])).alias("x"))
    lasso = LogisticRegression(featuresCol="x", elasticNetParam=1.0, regParam=rules.penalty, standardization=False, maxIter=100).fit(held)
    weights = lasso.coefficients.toArray()
    return Ensemble(float(lasso.intercept), [(float(w), r) for w, r in zip(weights, found, strict=True) if abs(w) > 1e-9])


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", rules: Rules = RULES) -> DataFrame:
    """One row ``(id, score)`` for each input row; ``score`` is from 0 to 1.

    ``labels`` are the rows that may be learnt from. Null and empty texts have the statistics of an
    empty text and are scored like any other. Repeated rows and null ids keep a row each; other
    columns are ignored. Without usable labels all scores are alike. An empty table gives an empty
    result.
    """
    stats = settle(stat_table(docs, id_col, text_col), "stats")
    model = fit(stats, labelled_sample(labels, label_id_col, label_col, rules.sample), rules)
    return stats.select("id", model.score([F.element_at("stats", k + 1) for k in range(len(STATS))]).alias("score"))
