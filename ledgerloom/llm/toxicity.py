"""Toxicity by weak supervision.

Many voters mark a document as toxic or abstain: words of a lexicon, stems that the
labelled rows suggest, and surface patterns. A generative label model estimates by
expectation maximisation how often each voter fires on either class, and the correlations of
voters within a class, by which it discounts voters that repeat each other. A
logistic regression on voters and stems is trained on the posterior labels and scores every
document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, map_arrow

#: Labelled rows of either class that the models are fitted on, at most, taken by a hash of the id.
SAMPLE = 10_000
#: Stems are features if toxic rows have them so many times as often, at a level that lets about so many pass by
#: accident, whatever the number of stems looked at; the best of them are voters too.
RATIO, ACCIDENTS, STEM_VOTERS = 4.0, 100, 64
#: Stems are these many first characters of a word; 0 is the whole word.
PREFIXES = (0, 4, 5, 6)
THRESHOLD = 0.3

# The lexicon.
LEXICON = """
idiot moron stupid dumb loser clown trash scum pathetic worthless disgusting imbecile fool jerk garbage vermin filth
ugly hate kill bastard idiota estupido imbecil basura asqueroso inutil payaso odio idiote imbecile stupide ordure nul
degoutant clown pourriture haine dummkopf trottel abschaum widerlich wertlos hass ekelhaft versager
""".split()
_ADDRESS = re.compile(r"\b(?:you are|you're|shut up|go away|get lost|tu es|du bist|eres)\b")
_MASKED = re.compile(r"\b[a-z][*@#$]{2,}[a-z]*\b")
PATTERNS = ["address", "masked", "shouting", "exclaiming"]

_SPLIT = {c: " " for c in range(128) if not chr(c).isalnum()}


def stems(text: str) -> set[str]:
    return set(text.lower().translate(_SPLIT).split())


def prefixes(word: str) -> list[str]:
    """The word itself, marked by a trailing blank, and its prefixes."""
    return [word + " "] + [word[:k] for k in PREFIXES if k and len(word) >= k]


def patterns(text: str) -> list[bool]:
    low = text.lower()
    letters = sum(map(str.isalpha, text)) if text.isupper() else 0
    return [bool(_ADDRESS.search(low)), bool(_MASKED.search(low)), letters > 20, text.count("!") * 20 > len(text) > 0]


@dataclass
class Features:
    """Places of the features: lexicon, patterns, stems; the voters are the first ones."""

    mined: list[str]
    place: dict[str, list[int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        words = list(dict.fromkeys(LEXICON))
        self.patterns_at = len(words)
        self.stems_at = self.patterns_at + len(PATTERNS)
        for k, w in enumerate(words):
            self.place.setdefault(w + " ", []).append(k)
        for k, s in enumerate(self.mined):
            self.place.setdefault(s, []).append(self.stems_at + k)
        self.size = self.stems_at + len(self.mined)
        self.voters = self.stems_at + min(STEM_VOTERS, len(self.mined))

    def of(self, text: str, cache: dict[str, tuple[int, ...]]) -> list[int]:
        found: set[int] = set()
        for w in stems(text):
            hit = cache.get(w)
            if hit is None:
                if len(cache) >= 1 << 20:
                    cache.clear()
                hit = cache[w] = tuple(k for p in prefixes(w) for k in self.place.get(p, ()))
            if hit:
                found.update(hit)
        found.update(self.patterns_at + k for k, x in enumerate(patterns(text)) if x)
        return sorted(found)


class LabelModel:
    """Two classes; voters fire or abstain, with a rate for each class.

    ``gold`` (1, 0) are labels of the same rows, themselves a voter whose accuracy is
    estimated, so a wrong label can be outvoted.
    """

    def fit(self, votes: np.ndarray, gold: np.ndarray, weight: np.ndarray, rounds: int = 25) -> LabelModel:
        p = np.where(gold == 1, 0.95, 0.02)
        self.right = np.array([0.95, 0.98])
        for _ in range(rounds):
            w1, w0 = weight * p, weight * (1 - p)
            self.prior = float(np.clip(w1.sum() / weight.sum(), 1e-3, 0.5))
            self.rates = np.stack([(w0 @ votes + 0.01) / (w0.sum() + 1), (w1 @ votes + 0.01) / (w1.sum() + 1)])
            self.rates = np.clip(self.rates, 1e-4, 1 - 1e-4)
            self.right = np.clip([(w1 @ gold + 1) / (w1.sum() + 1.1), (w0 @ (1 - gold) + 1) / (w0.sum() + 1.1)], 0.6, 0.99)
            self.discount = self._discount(votes, w1)
            p = self.posterior(votes, gold)
        return self

    def _discount(self, votes: np.ndarray, w: np.ndarray) -> np.ndarray:
        """One over the sum of a voter's positive correlations with all voters within the toxic class."""
        mean = w @ votes / max(w.sum(), 1e-9)
        centred = votes - mean
        cov = (centred * w[:, None]).T @ centred / max(w.sum(), 1e-9)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        self.correlations = np.clip(cov / np.outer(sd, sd), -1, 1)
        strong = np.where(self.correlations > 0.3, self.correlations, 0)
        np.fill_diagonal(strong, 1)
        return 1 / strong.sum(1)

    def posterior(self, votes: np.ndarray, gold: np.ndarray | None = None) -> np.ndarray:
        fire = np.log(self.rates[1] / self.rates[0]) * self.discount
        # Silence says little and is itself correlated: its evidence is shared by all voters.
        quiet = np.log((1 - self.rates[1]) / (1 - self.rates[0])) / max(1, len(fire)) * 4
        z = np.log(self.prior / (1 - self.prior)) + votes @ fire + (1 - votes) @ quiet
        if gold is not None:
            z = z + np.where(gold == 1, np.log(self.right[0] / (1 - self.right[1])), np.log((1 - self.right[0]) / self.right[1]))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, penalty: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft targets, by accelerated gradient steps."""
    n, k = x.shape
    w, b, v, c = np.zeros(k), 0.0, np.zeros(k), 0.0
    total = weight.sum()
    # The curvature is at most a quarter of the largest eigenvalue of the weighted products of features.
    u, size = np.ones(k + 1), 1.0
    for _ in range(20):
        y = weight * (x @ u[:k] + u[k]) / total
        u = np.append(x.T @ y, y.sum())
        size = float(np.linalg.norm(u))
        u = u / max(size, 1e-12)
    step = 1 / (0.25 * 1.2 * size + penalty / n + 1e-9)
    for t in range(rounds):
        g = weight * (1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30))) - target) / total
        new, bias = v - step * (x.T @ g + penalty * v / n), c - step * g.sum()
        m = t / (t + 3)
        v, c = new + m * (new - w), bias + m * (bias - b)
        w, b = new, bias
    return w, b


def held_out(col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string")) % 4 == 2


def _mine(tables: Tables, sample: DataFrame, counts: tuple[int, int]) -> list[str]:
    """Stems by the strength of their tie to toxic labels; counted by Spark, all that pass the test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for s in {p for w in stems(text or "") for p in prefixes(w)}:
                    seen.setdefault(s, [0, 0])[toxic] += 1
            # Partial counts leave whenever they grow, so memory stays bounded.
            if len(seen) > 500_000:
                yield packed(seen)
                seen = {}
        if seen:
            yield packed(seen)

    def packed(seen: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen)), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())],
            names=["stem", "clean", "toxic"],
        )

    clean, toxic = counts
    found = map_arrow(sample.select("toxic", "text"), run, "stem string, clean long, toxic long")
    found = tables.write(found.groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    rate = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("clean") + 0.5) / (clean + 1))
    # Twice the log likelihood ratio of two rates against one, at a level divided by the number of stems.
    total, both = clean + toxic, F.col("clean") + F.col("toxic")
    part = lambda x, mean: F.when(x > 0, x * F.log(x / mean)).otherwise(0.0)
    cells = [part(F.col(c), both * n / total) + part(n - F.col(c), (total - both) * n / total) for c, n in (("clean", clean), ("toxic", toxic))]
    least = 2 * float(np.log(max(1, found.count()) / ACCIDENTS))
    chosen = found.where((rate > RATIO) & (2 * (cells[0] + cells[1]) > least)).select("stem", (F.col("toxic") * F.log(rate)).alias("score"))
    return [r["stem"] for r in sorted(chosen.collect(), key=lambda r: (-r["score"], r["stem"]))]  # each is in several of the sample's toxic rows


@dataclass
class Scorer:
    features: Features
    weights: np.ndarray
    bias: float
    label_model: LabelModel | None = None

    def score(self, found: list[int]) -> float:
        z = self.bias + float(self.weights[found].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Scorer:
    """Fits label model and classifier on at most ``per_class`` labelled rows of either class.

    Rows whose id is held out are never read; of several labels of one id the largest counts, and of
    several texts the least; null labels and ids are left out; other columns are not read. Without labels of both
    classes, or in an empty table, the lexicon alone scores.
    """
    spark = docs.sparkSession
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(~held_out())
    usable = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in usable.groupBy("toxic").count().collect()}
    n = (counts.get(0, 0), counts.get(1, 0))
    alone = Features([])
    unfitted = Scorer(alone, np.concatenate([np.full(alone.patterns_at, 3.0), np.full(len(PATTERNS), 0.5)]), -3.0)
    if not all(n):
        return unfitted
    with Tables(spark) as tables:
        picked = [usable.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
        ids = tables.write(picked[0].union(picked[1]).select(F.col("doc_id").alias("id"), "toxic"))  # at most 2 * per_class rows
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        sample = texts.join(F.broadcast(ids), texts.doc_id == ids.id).groupBy("id", "toxic").agg(F.min("text").alias("text"))
        sample = tables.write(sample)
        used = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
        used = (used.get(0, 0), used.get(1, 0))
        if not all(used):
            return unfitted
        features = Features(_mine(tables, sample, used))
        shared = spark.sparkContext.broadcast(features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache: dict = {}
            for batch in batches:
                found = [shared.value.of(t or "", cache) for t in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["id", "toxic", "found"])

        rows = map_arrow(sample, run, "id long, toxic int, found array<int>").orderBy("id").collect()
    x = np.zeros((len(rows), features.size), np.float32)
    for k, r in enumerate(rows):
        x[k, r["found"]] = 1
    gold = np.array([r["toxic"] for r in rows], float)
    # A row stands for as many as its class has for each one taken.
    weight = np.where(gold == 1, n[1] / used[1], n[0] / used[0])
    model = LabelModel().fit(x[:, : features.voters].astype(float), gold, weight)
    target = model.posterior(x[:, : features.voters].astype(float), gold)
    weights, bias = logistic(x, target, weight)
    return Scorer(features, weights, bias, model)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """One row per document: doc_id, ``score`` from 0 to 1.

    Null and empty texts have the bias alone; repeated rows give repeated results; whole texts
    count, however long; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = shared.value, {}
        for batch in batches:
            scores = [own.score(own.features.of(t or "", cache)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(texts, run, "doc_id long, score double")


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document its score and whether that reaches the threshold; see ``fit`` and ``score`` for awkward rows."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
