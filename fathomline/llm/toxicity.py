"""Toxicity by weak supervision.

Many voters look at a text: lexicons in four languages, patterns, and lexicons of terms that the
labelled rows show to be telling. A label model learns, from how often voters agree over all
documents, how often each one votes for toxic and for clean texts, and which voters depend on each
other. Its posterior labels train a linear classifier on the voters' counts, which scores all texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sampling import labelled_sample
from .scratch import settle, small

WORD = re.compile(r"[^\W\d_]+")

#: Words that insult, by language, and of hostility in general.
LEXICONS = {
    "insults_en": "idiot idiots moron morons stupid imbecile fool loser losers clown clowns dumb dumbass dimwit halfwit scumbag jerk creep",
    "contempt_en": "trash garbage filth scum vermin worthless pathetic disgusting despicable subhuman parasite parasites vile",
    "profanity_en": "fuck fucking fucker shit shitty bullshit bitch bastard asshole crap damn dickhead prick cunt whore slut",
    "insults_fr": "idiot idiote imbécile connard connasse salaud salope abruti abrutie crétin crétine débile ordure merde pute enculé minable",
    "insults_de": "idiot trottel dummkopf arschloch scheiße scheisse hurensohn wichser schlampe abschaum vollidiot depp missgeburt versager",
    "insults_es": "idiota imbécil estúpido estúpida cabrón puta puto mierda gilipollas pendejo basura escoria inútil patético asqueroso",
}
#: Patterns, in lower case. A text without any of a pattern's CUES can't match it.
PATTERNS = {
    "threat": r"\b(?:i|we)(?: will|'ll| am going to| are going to) (?:kill|hurt|destroy|beat|find) (?:you|them|him|her)\b|\bkill yourself\b|\bgo die\b|\bdrop dead\b",
    "second_person": r"\byou(?:'re| are|r)? (?:an? |such an? |all |so |fucking |nothing but )*(?:idiot|moron|stupid|loser|clown|scum|trash|worthless|pathetic|disgusting|dumb|bitch|bastard)",
    "dismissal": r"\bshut (?:the \w+ )?up\b|\bnobody (?:likes|wants|asked) you\b|\bgo to hell\b|\bscrew you\b|\bget lost\b",
    "hatred": r"\b(?:i|we) (?:hate|despise|loathe) (?:you|them|all|those)\b|\bthey should all (?:die|be)\b",
}
CUES = {"threat": "kill hurt destroy beat find die dead", "second_person": "you", "dismissal": "shut nobody hell screw lost", "hatred": "hate despise loathe should"}


@dataclass(frozen=True)
class Rules:
    """``sample``: labelled rows that are learnt from at most; all other rows together weigh as much as so
    many. Telling terms are dealt to ``groups`` voters by their stems of ``stem`` letters. ``prior`` is the
    share of toxic texts where no label says more. A term is telling if, with 95 percent confidence,
    over ``least_share`` of the texts that hold it are toxic. First letters whose share is, as surely,
    ``hint_lift`` times the prior are hints, dealt to ``hint_groups`` voters: one word of a kind says
    nothing, several do. Labels are right ``label_right`` of the time."""

    sample: int = 20_000
    groups: int = 10
    hint_groups: int = 5
    stem: int = 4
    prior: float = 0.08
    least_share: float = 0.6
    hint_lift: float = 2.8
    label_right: float = 0.95


RULES = Rules()


def _terms(words: set[str], stem: int) -> set[str]:
    """Whole words, and the first letters of longer ones, marked by a hyphen."""
    return words | {w[:n] + "-" for w in words for n in (stem, stem + 1, stem + 2) if len(w) >= n}


@dataclass
class Voters:
    """``table``: each term's voters; patterns follow. ``names`` are in the order of the votes."""

    names: list[str]
    table: dict[str, tuple[int, ...]]
    stem: int
    hints: frozenset[int] = frozenset()
    patterns: list[tuple[re.Pattern, list[str]]] = field(default_factory=lambda: [(re.compile(p), CUES[n].split()) for n, p in PATTERNS.items()])

    def __post_init__(self) -> None:
        self.starts = frozenset(t[: self.stem] for t in self.table)

    @classmethod
    def of(cls, learnt: list[str], rules: Rules, hints: list[str] = ()) -> Voters:
        table: dict[str, list[int]] = {}
        for k, words in enumerate(LEXICONS.values()):
            for w in words.split():
                table.setdefault(w, []).append(k)
        first = len(LEXICONS)
        for terms, groups in ((learnt, rules.groups), (hints, rules.hint_groups)):
            stems: dict[str, int] = {}
            for term in terms:
                group = stems.setdefault(term[: rules.stem], len(stems) % groups)
                table.setdefault(term, []).append(first + group)
            first += groups
        names = [*LEXICONS, *(f"learnt_{g}" for g in range(rules.groups)), *(f"hints_{g}" for g in range(rules.hint_groups)), *PATTERNS]
        return cls(names, {t: tuple(dict.fromkeys(v)) for t, v in table.items()}, rules.stem, frozenset(range(first - rules.hint_groups, first)))

    def counts(self, text: str) -> np.ndarray:
        """How often each voter's terms or pattern occur; a word counts once for a voter. For hints: how
        many different words beyond the first."""
        text, out, stem = text.lower(), np.zeros(len(self.names)), self.stem
        find, starts = self.table.get, self.starts
        for w, n in [x for x in Counter(WORD.findall(text)).items() if x[0][:stem] in starts]:
            hit = find(w, ())
            for m in (stem, stem + 1, stem + 2):
                if len(w) >= m:
                    hit += find(w[:m] + "-", ())
            for k in set(hit):
                out[k] += 1 if k in self.hints else n
        for k in self.hints:
            out[k] = max(0, out[k] - 1)
        first = len(self.names) - len(self.patterns)
        for k, (p, cues) in enumerate(self.patterns):
            if any(c in text for c in cues):
                out[first + k] = sum(1 for _ in p.finditer(text))
        return out


@dataclass
class LabelModel:
    """``hit`` and ``false``: how often each voter votes for a toxic and for a clean text; ``weight``:
    what its vote counts for beside those it depends on; ``prior``: the share of toxic texts."""

    prior: float
    hit: np.ndarray
    false: np.ndarray
    weight: np.ndarray
    dependent: np.ndarray

    def logits(self) -> tuple[float, np.ndarray]:
        """Start and step for each vote of the posterior's log odds."""
        yes, no = np.log(self.hit / self.false), np.log((1 - self.hit) / (1 - self.false))
        return math.log(self.prior / (1 - self.prior)) + float((self.weight * no).sum()), self.weight * (yes - no)


def fit_label_model(n: float, ones: np.ndarray, pairs: np.ndarray, prior: float, told: np.ndarray | None = None, label_right: float = RULES.label_right, rounds: int = 50) -> LabelModel:
    """From the number of texts, votes of each voter and of each pair of voters together.

    If votes are independent given the label, the covariances off the diagonal are products v_i v_j
    with v_i = (hit_i - false_i) sqrt(prior (1 - prior)): accuracies follow from agreement alone. Pairs
    whose covariance is far above that product are dependent; they leave the fit, and share weight.
    Labels are one more voter, with a known share of right votes, that is silent on most texts:
    ``told`` has each voter's covariance with it where it votes, and weighs as much as the others.
    """
    size, tiny = len(ones), 0.5 / max(n, 1)
    mean = ones / max(n, 1)
    cov = pairs / max(n, 1) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    off = ~np.eye(size, dtype=bool)
    dependent, scale = np.zeros((size, size), bool), math.sqrt(prior * (1 - prior))
    # A voter can't vote for more than all toxic texts: v_i <= mean_i / prior * scale.
    top = np.minimum(1.0, mean / prior) * scale
    # Three voters tell of one: v_i^2 = cov_ij cov_ik / cov_jk. The median over many bears dependent pairs.
    sure = off & (cov > 4 * np.outer(sd, sd) / math.sqrt(max(n, 1)))
    v = 0.5 * top
    for i in range(size):
        j, k = (x.ravel() for x in np.meshgrid(*[np.flatnonzero(sure[i])] * 2, indexing="ij"))
        good = (j < k) & sure[j, k]
        if good.any():
            v[i] = np.sqrt(np.median(cov[i, j[good]] * cov[i, k[good]] / cov[j[good], k[good]]))
    v = np.clip(v, 0, top)
    for _ in range(4):
        dependent = off & ((cov - np.outer(v, v)) / np.outer(sd, sd) > 0.2)
        use = off & ~dependent
        for _ in range(rounds):
            rest = use * v[None, :]
            upper, lower = (rest * np.where(use, cov, 0)).sum(1), (rest**2).sum(1)
            if told is not None:
                known = (2 * label_right - 1) * scale
                upper, lower = upper + size * known * told, lower + size * known**2
            v = 0.5 * v + 0.5 * np.clip(upper / np.maximum(lower, 1e-15), 0, top)
    step = v / scale
    false = np.clip(mean - prior * step, tiny, 0.5)
    hit = np.clip(false + step, false, 1 - tiny)
    share = np.where(dependent, np.clip((cov - np.outer(v, v)) / np.outer(sd, sd), 0, 1), 0).sum(1)
    return LabelModel(prior, hit, false, 1 / (1 + share), dependent)


def _minhashes(words: list[str]) -> list[int]:
    """Four minima of hashes of the text's runs of three words."""
    runs = {" ".join(words[i : i + 3]).encode("utf-8", "replace") for i in range(max(1, len(words) - 2))}
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, runs), np.uint64, len(runs))
    return [int((hashes * np.uint64(m)).min().view(np.int64)) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _distinct_sample(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Texts of the sample (``text``, ``label``), one of each group of near copies: copies of one text say no more."""
    rows = docs.join(F.broadcast(sample), docs["id"] == sample["key"]).select("text", "label")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = [t or "" for t in b.column(0).to_pylist()]
            marks = [_minhashes(WORD.findall(t.lower())) for t in texts]
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array(texts), b.column(1), *(pa.array(m, pa.int64()) for m in zip(*marks, strict=True))], ["text", "label", "m0", "m1", "m2", "m3"])

    held = settle(rows.mapInArrow(each, "text string, label int, m0 long, m1 long, m2 long, m3 long"), "sample")
    held = held.groupBy("text", "label").agg(*[F.min(f"m{k}").alias(f"m{k}") for k in range(4)])  # copies of a text have its minima
    held = settle(held.withColumn("mark", F.sha2("text", 256)), "marked")
    # Of the texts that share a minimum, the one with the least mark stays, whatever the order of rows.
    first = held.select("mark", "label", *[(F.row_number().over(Window.partitionBy(f"m{k}").orderBy("mark", "label")) == 1).alias(f"first{k}") for k in range(4)])
    kept = settle(first.where("first0 and first1 and first2 and first3").select("mark", "label"), "kept")
    return held.join(F.broadcast(kept), ["mark", "label"]).select("text", "label")  # as bounded as the sample


def _learnt_terms(docs: DataFrame, sample: DataFrame, prior: float, rules: Rules) -> tuple[list[str], list[str]]:
    """The terms that tell toxic texts in the labelled sample, and hints, best first; no more come to the driver than the sample has."""
    rows = _distinct_sample(docs, sample)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            sums: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[label].update(_terms(set(WORD.findall((text or "").lower())), rules.stem))
            terms = list(sums[0].keys() | sums[1].keys())
            if terms:
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array([sums[1][t] for t in terms], pa.int64()), pa.array([sums[0][t] for t in terms], pa.int64())], ["term", "toxic", "clean"])

    sums = rows.mapInArrow(each, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # Wilson's lower bound of the share of toxic texts among those with the term.
    n, z = F.col("toxic") + F.col("clean"), 1.96
    p = F.col("toxic") / n
    bound = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    rated = settle(sums.withColumn("bound", bound).where(F.col("bound") >= min(rules.least_share, rules.hint_lift * prior)), "terms")
    order = [F.desc(F.col("toxic") - 3 * F.col("clean")), F.asc("term")]
    taken = lambda df: {r["term"]: (r["toxic"], r["clean"]) for r in df.orderBy(*order).collect()}
    sharp = taken(rated.where(F.col("bound") >= rules.least_share))
    dull = taken(rated.where((F.col("bound") < rules.least_share) & F.col("term").endswith("-")))
    hints = [t for t in _specific(sharp | dull) if t in dull]
    # of first letters that nest, the shorter say all
    known = {u[:-1] for u in hints}
    return _specific(sharp), [t for t in hints if not any(t[:n] in known for n in range(1, len(t) - 1))]


def _specific(counts: dict[str, tuple[int, int]]) -> list[str]:
    """The terms but for first letters most of whose toxic texts a longer term covers, with fewer clean ones."""
    longer: dict[str, list[str]] = {}
    for t in counts:
        for n in range(1, len(t) + 1):
            longer.setdefault(t[:n], []).append(t)
    out = []
    for term, (toxic, clean) in counts.items():
        start = term.removesuffix("-")
        rest = (counts[t] for t in longer[start] if t != term and term != start)
        if not any(c[0] >= 0.8 * toxic and c[1] < clean for c in rest):
            out.append(term)
    return out


def _told(counts: DataFrame, sample: DataFrame, size: int) -> np.ndarray:
    """Each voter's covariance with the labels, over the sample."""
    rows = counts.join(F.broadcast(sample), counts["id"] == sample["key"])
    votes = [(F.element_at("counts", k + 1) > 0).cast("double") for k in range(size)]
    r = rows.agg(*[F.covar_pop(v, F.col("label").cast("double")).alias(f"v{k}") for k, v in enumerate(votes)]).first()
    return np.array([r[f"v{k}"] or 0.0 for k in range(size)])


def _count_table(docs: DataFrame, voters: Voters) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            counts = [voters.counts(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.list_(pa.float64()))], ["id", "counts"])

    return docs.mapInArrow(each, f"id {docs.schema['id'].dataType.simpleString()}, counts array<double>")


def _votes_summed(counts: DataFrame, size: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Texts, votes and joint votes over all rows: matrices of the voters, summed by task, then all."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, pairs = 0, np.zeros((size, size))
        for b in small(batches):
            if b.num_rows:
                v = (np.stack([np.asarray(x.values) for x in b.column(0)]) > 0).astype(float)
                n, pairs = n + b.num_rows, pairs + v.T @ v
        at = np.arange(size * size + 1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(pairs.ravel(), n))], ["at", "sum"])

    rows = counts.select("counts").mapInArrow(each, "at long, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).collect()
    flat = np.zeros(size * size + 1)
    for r in rows:
        flat[r["at"]] = r["sum"]
    pairs = flat[:-1].reshape(size, size)
    return float(flat[-1]), np.diag(pairs).copy(), pairs


def _linear(start: float, steps: np.ndarray, at: list[Column]) -> Column:
    out = F.lit(start)
    for w, c in zip(steps, at, strict=True):
        if abs(w) > 1e-12:
            out = out + F.lit(float(w)) * c
    return out


def toxicity_scores(docs: DataFrame, labels: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", rules: Rules = RULES) -> DataFrame:
    """One row ``(id, score, posterior)`` for each input row; ``score`` is from 0 to 1.

    ``labels`` are the rows that may be learnt from; of them a sample of ``rules.sample`` trains, by a
    hash of the id. The label model and the classifier are fitted to the votes of all documents; how
    rows are partitioned changes scores by rounding alone. Without
    labels the written lexicons and patterns alone vote. Null and empty texts get no vote and the
    score of such texts. Repeated rows and null ids keep a row each; other columns are ignored. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known, learnt, hints, prior = None, [], [], rules.prior
    if labels is not None:
        known = labelled_sample(labels, label_id_col, label_col, rules.sample)
        told = known.agg(F.count("*").alias("n"), F.sum("label").alias("k")).first()
        prior = ((told["k"] or 0) + 10 * rules.prior) / (told["n"] + 10)
        learnt, hints = _learnt_terms(rows, known, prior, rules)
    voters = Voters.of(learnt, rules, hints)
    counts = settle(_count_table(rows, voters), "votes")
    told = _told(counts, known, len(voters.names)) if known is not None else None
    model = fit_label_model(*_votes_summed(counts, len(voters.names)), prior, told, rules.label_right)

    at = [F.element_at("counts", k + 1) for k in range(len(voters.names))]
    votes = [(c > 0).cast("double") for c in at]
    start, steps = model.logits()
    odds = _linear(start, steps, votes)
    # Counts grow slowly in long texts: logarithms, how many voters voted, and how many words hit.
    features = [*[F.log1p(c) for c in at], F.log1p(sum(votes, F.lit(0.0))), F.log1p(sum(at, F.lit(0.0)))]
    total = counts.count()
    if not total:
        return counts.select("id", F.lit(0.0).alias("score"), F.lit(0.0).alias("posterior"))
    # Texts with the same counts are one row; together they weigh as much as ``sample`` texts.
    alike = counts.groupBy("counts").agg(F.count("*").alias("n"))
    train = alike.select((F.col("n") * F.lit(min(1.0, rules.sample / total))).alias("n"), odds.alias("odds"), *[f.alias(f"f{k}") for k, f in enumerate(features)])
    if known is not None:
        # Where the label votes too, its log odds add to those of the others.
        sure = math.log(rules.label_right / (1 - rules.label_right))
        seen = counts.join(F.broadcast(known), counts["id"] == known["key"]).select(F.lit(1.0).alias("n"), (odds + F.when(F.col("label") == 1, sure).otherwise(-sure)).alias("odds"), *[f.alias(f"f{k}") for k, f in enumerate(features)])
        train = train.unionByName(seen)
    train = settle(train.withColumn("p", 1 / (1 + F.exp(-F.greatest(F.least("odds", F.lit(30.0)), F.lit(-30.0))))), "training")
    vector = array_to_vector(F.array(*[F.col(f"f{k}") for k in range(len(features))])).alias("x")
    both = train.select(vector, F.lit(1.0).alias("y"), (F.col("n") * F.col("p")).alias("w")).unionByName(train.select(vector, F.lit(0.0).alias("y"), (F.col("n") * (1 - F.col("p"))).alias("w")))
    fit = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1e-4, maxIter=60).fit(both)
    score = 1 / (1 + F.exp(-_linear(float(fit.intercept), np.array(fit.coefficients.toArray()), features)))
    return counts.select("id", score.alias("score"), (1 / (1 + F.exp(-odds))).alias("posterior"))
