"""Toxicity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight vector for all thresholds, which are kept in
order. x counts, for hashed features, the distinct words of a text that have the feature: the word
itself and its first letters, so that inflected forms share evidence. Trained by
follow-the-regularised-leader with an L1 penalty on at most about ``per_grade`` labelled rows of each
grade (chosen by a hash of the id), weighted back to the shares of the grades in all labels.
"""

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ship import ship

BUCKETS = 1 << 18
STEMS = (4, 5)
PER_GRADE = 2000
MAX_GRADES = 16
EPOCHS = 6
LEAST_STEPS = 20_000  # few rows are gone through more often
ALPHA, BETA, L2 = 0.3, 1.0, 0.01
L1_PER_ROW = 0.001  # the penalty meets sums of gradients, which grow with the rows
CACHE_WORDS = 1 << 18
WORD = re.compile(r"[^\W\d_]+")


def buckets(word: str) -> list[int]:
    """Feature numbers of a lower-case word."""
    forms = [f"={word}"] + [f"^{word[:n]}" for n in STEMS if len(word) >= n]
    return [zlib.crc32(f.encode("utf-8", "replace")) % BUCKETS for f in forms]


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


@dataclass
class Model:
    grades: int
    weights: np.ndarray
    thresholds: list[float]  # one fewer than grades, ascending

    def probabilities(self, score: float) -> list[float]:
        """P(grade >= 1), P(grade >= 2), ..."""
        return [1 - _sigmoid(t - score) for t in self.thresholds]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: list[int], weights: list[float],
        levels: int) -> Model:
    """Online training; features of fewer than three rows are left out."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    seen = np.zeros(BUCKETS, np.int32)
    for at, _ in rows:
        seen[at] += 1
    shares = np.bincount(grades, weights=weights, minlength=levels)
    below = np.cumsum(shares)[:-1] / max(shares.sum(), 1e-9)
    below = np.clip(below, 1e-3, 1 - 1e-3)
    thresholds = np.maximum.accumulate(np.log(below / (1 - below)) + np.arange(levels - 1) * 1e-3)
    moved = np.ones(max(levels - 1, 0))
    l1 = L1_PER_ROW * len(rows)
    order = np.random.default_rng(7)

    def current(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        w = (np.sign(zs) * l1 - zs) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    kept = [(at[seen[at] >= 3], x[seen[at] >= 3]) for at, x in rows]
    epochs = max(EPOCHS, -(-LEAST_STEPS // max(len(rows), 1)))
    for _ in range(epochs if levels > 1 and rows else 0):
        for i in order.permutation(len(kept)):
            at, x = kept[i]
            w = current(at)
            s, k = float(w @ x), grades[i]
            high = _sigmoid(thresholds[k] - s) if k < levels - 1 else 1.0
            low = _sigmoid(thresholds[k - 1] - s) if k else 0.0
            p = max(high - low, 1e-6)
            slope_high, slope_low = high * (1 - high), low * (1 - low)
            g = weights[i] * (slope_high - slope_low) / p * x
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
            for j, slope in ((k, -slope_high / p), (k - 1, slope_low / p)):
                if 0 <= j < levels - 1:
                    step = weights[i] * slope
                    moved[j] += step * step
                    thresholds[j] -= 0.3 * step / math.sqrt(moved[j])
            thresholds = np.maximum.accumulate(thresholds)
    return Model(levels, current(np.arange(BUCKETS)), [float(t) for t in thresholds])


def train(docs: DataFrame, graded: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          per_grade: int = PER_GRADE) -> Model:
    """Learn from ``graded`` (doc_id, grade 0, 1, ...) and the texts of those documents."""
    ship(docs.sparkSession)
    known = graded.where("doc_id is not null and grade between 0 and " + str(MAX_GRADES - 1))
    sizes = {r["grade"]: r["count"] for r in known.groupBy("grade").count().collect()}
    levels = max(sizes, default=0) + 1
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    share = F.coalesce(*[F.when(F.col("grade") == g, math.ceil((1 << 20) * min(1, per_grade / c)))
                         for g, c in sizes.items()], F.lit(0))
    drawn = known.where(draw < share).select("doc_id", F.col("grade").cast("int").alias("grade"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, grade, text in zip(pdf["doc_id"], pdf["grade"], pdf["_text"]):
                found = Counter(b for w in words(text) for b in buckets(w))
                out.append((key, grade, list(found), list(found.values())))
            yield pd.DataFrame(out, columns=["doc_id", "grade", "at", "x"])

    # at most MAX_GRADES * per_grade ids (expected), so this side is small by construction
    rows = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "grade", "_text").mapInPandas(
        features, "doc_id long, grade int, at array<int>, x array<int>").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    counts = Counter(rows["grade"])
    total = sum(sizes.values())
    weights = [sizes[g] / total * len(rows) / counts[g] for g in rows["grade"]]
    weights = [min(w, 5.0) for w in weights]
    pairs = [(np.asarray(a, np.int64), np.asarray(x, float)) for a, x in zip(rows["at"], rows["x"])]
    return fit(pairs, [int(g) for g in rows["grade"]], weights, levels)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Struct column (toxicity, expected_severity, grade) for a text column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    class Weights(dict):
        def __missing__(self, word: str) -> float:
            if len(self) >= CACHE_WORDS:
                self.clear()
            weight = self[word] = float(shared.value.weights[buckets(word)].sum())
            return weight

    @F.pandas_udf("toxicity double, expected_severity double, grade int")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Weights()
        for texts in batches:
            out = []
            for text in texts:
                at_least = shared.value.probabilities(sum(map(known.__getitem__, sorted(words(text)))))
                out.append((at_least[0] if at_least else 0.0, float(sum(at_least)),
                            sum(p >= 0.5 for p in at_least)))
            yield pd.DataFrame(out, columns=["toxicity", "expected_severity", "grade"])

    return score(F.col(text_col))


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 not toxic, 1 toxic, 2 toxic and of low quality; rows with a null label go."""
    return labels.select("doc_id", F.when(F.col("toxic") == 0, 0).when(
        (F.col("toxic") == 1) & (F.col("quality") == 1), 1).when(
        (F.col("toxic") == 1) & (F.col("quality") == 0), 2).alias("grade")).where("grade is not null")


def toxicity(docs: DataFrame, graded: DataFrame, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, toxic, grade, expected_severity, toxicity``.

    ``toxicity`` is P(grade >= 1), ``expected_severity`` the mean grade, ``grade`` the highest one
    reached with probability 0.5, ``toxic`` whether that is above 0. Null and empty texts have no
    words and get the grade of the intercepts; without labels everything is grade 0. Repeated rows
    are scored alike; null ids are scored but not learned from. Other columns are ignored.
    """
    model = train(docs, graded, id_col, text_col)
    return docs.select(F.col(id_col).alias("doc_id"), scored(docs, model, text_col).alias("s")).select(
        "doc_id", (F.col("s.grade") > 0).alias("toxic"), "s.grade", "s.expected_severity",
        "s.toxicity")
