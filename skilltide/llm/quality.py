"""Quality by naive Bayes support vectors.

Features are indicators of hashed n-grams: one and two neighbouring tokens, and one to three neighbouring
shapes of tokens (how a token is written, whether it repeats the one before). A token is a run of word characters or
a run of other visible ones. Each indicator is scaled by its log-count ratio, the logarithm of how much more
often documents of label 1 have it than those of label 0; the ratios count all labelled rows to learn from. A
linear hinge-loss model over the scaled vectors, each of length 1, is fitted by dual coordinate descent
on a bounded sample of the labelled rows, ``per_class`` of each label; a fifth of the sample turns margins into
probabilities.
"""

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .align import chunks, distinct
from .perfecthash import mixed
from .rows import filtered_joins, mapped
from .ship import ship

BUCKETS = 1 << 18
SMOOTHING = 1.0
PER_CLASS = 3000
EPOCHS = 20
COST = 1.0
THRESHOLD = 0.3
HELD_TOKENS = 1 << 18
TOKEN = re.compile(r"\w+|[^\w\s]+")
REPEATED = 1  # shape of a token that repeats the one before


def shape(token: str) -> int:
    """A small number for how a token is written: case and digits of a word, the first mark of others."""
    if not (token[0].isalnum() or token[0] == "_"):
        return 16 + 2 * (zlib.crc32(token[0].encode()) % (1 << 16)) + (len(token) > 1)
    if any(c.isdigit() for c in token):
        return 2
    if token.islower():
        return 3
    if len(token) > 1 and token.isupper():
        return 4
    return 5 if token.istitle() else 6


class _Tokens(dict):
    """Token -> its hash and shape in one number."""

    def __missing__(self, token: str) -> int:
        if len(self) >= HELD_TOKENS:
            self.clear()
        code = self[token] = zlib.crc32(token.lower().encode()) | shape(token) << 32
        return code


_tokens = _Tokens()


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature that a text has, once and in order."""
    found = [TOKEN.findall(t) for t in texts]
    codes = np.fromiter(map(_tokens.__getitem__, chain.from_iterable(found)), np.int64)
    text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, found), np.int64))
    words, shapes = codes & 0xFFFFFFFF, codes >> 32
    shapes[1:][(words[1:] == words[:-1]) & (text[1:] == text[:-1])] = REPEATED
    parts = []
    for kind, values, longest in ((1, words, 2), (2, shapes, 3)):
        held = values
        for n in range(1, longest + 1):
            if n > 1:
                held = mixed(held[:-1], n)[:len(values) - n + 1].astype(np.int64) ^ values[n - 1:]
            inside = text[n - 1:] == text[:len(text) - n + 1]
            bucket = (mixed(held, 10 * kind + n) % np.uint64(BUCKETS)).astype(np.int64)
            parts.append((text[n - 1:] * BUCKETS + bucket)[inside])
            if len(values) <= n:
                break
    return np.divmod(distinct(np.concatenate(parts)), BUCKETS)


@dataclass
class Model:
    ratios: np.ndarray  # of each bucket
    weights: np.ndarray
    offset: float
    slope: float  # probability = sigmoid(slope * margin + level)
    level: float

    def margins(self, texts: list[str]) -> np.ndarray:
        text, at = features(texts)
        total = np.bincount(text, (self.weights * self.ratios)[at], len(texts))
        length = np.sqrt(np.bincount(text, self.ratios[at] ** 2, len(texts)))
        return np.divide(total, length, out=np.zeros(len(texts)), where=length > 0) + self.offset

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return _sigmoid(self.slope * self.margins(texts) + self.level)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def log_count_ratios(counts: np.ndarray) -> np.ndarray:
    """From documents of label 0 and 1 that have each bucket, two columns."""
    smoothed = counts + SMOOTHING
    shares = np.log(smoothed / smoothed.sum(axis=0))
    return np.where(counts.any(axis=1), shares[:, 1] - shares[:, 0], 0.0)


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray,
                            costs: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset that minimise half their squares plus ``costs`` times the hinge losses.

    Each row has buckets and values; a last value of 1 stands for the offset. One dual variable at a time
    moves to its best place between 0 and the row's cost.
    """
    weights, offset = np.zeros(BUCKETS), 0.0
    alpha, order = np.zeros(len(rows)), np.random.default_rng(11)
    square = np.array([float(x @ x) + 1.0 for _, x in rows])
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            slope = signs[i] * (float(weights[at] @ x) + offset) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), costs[i])
            step = (new - alpha[i]) * signs[i]
            if step:
                alpha[i] = new
                weights[at] += step * x
                offset += step
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return weights, offset


def calibrated(margins: np.ndarray, labels: np.ndarray, shares: np.ndarray) -> tuple[float, float]:
    """Slope and level of the probability, by Newton steps on the weighted, slightly smoothed log loss."""
    counts = np.bincount(labels, minlength=2)
    weights = (shares / np.maximum(counts, 1))[labels] * len(labels)
    target = np.where(labels == 1, (counts[1] + 1) / (counts[1] + 2), 1 / (counts[0] + 2))
    x = np.column_stack([margins, np.ones(len(margins))])
    z = np.array([1.0, math.log((shares[1] + 1e-6) / (shares[0] + 1e-6))])

    def loss(z: np.ndarray) -> float:
        m = x @ z
        return float(weights @ (np.logaddexp(0, m) - target * m)) + 1e-3 * float(z @ z)

    for _ in range(50):
        p = _sigmoid(x @ z)
        gradient = x.T @ (weights * (p - target)) + 2e-3 * z
        curve = x.T @ (x * (weights * p * (1 - p))[:, None]) + 2e-3 * np.eye(2)
        step, size = np.linalg.solve(curve, gradient), 1.0
        while size > 1e-6 and loss(z - size * step) > loss(z):
            size /= 2
        z = z - size * step
        if abs(size * step).max() < 1e-6:
            break
    return max(float(z[0]), 0.0), float(z[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> Model:
    """From the buckets and labels of a sample, the counts of ``log_count_ratios`` and the labelled rows
    of each label in all."""
    ratios = log_count_ratios(counts)
    shares = (sizes + 1) / (sizes + 1).sum()
    constant = Model(ratios, np.zeros(BUCKETS), 0.0, 0.0, math.log(shares[1] / shares[0]))
    held = np.arange(len(rows)) % 5 == 4
    if not all(((labels == k) & h).any() for k in (0, 1) for h in (held, ~held)):
        return constant
    vectors = []
    for at in rows:
        x = ratios[at]
        length = math.sqrt(float(x @ x))
        vectors.append((at, x / length if length else x))
    chosen = np.flatnonzero(~held)
    even = COST * len(chosen) / (2 * np.bincount(labels[chosen], minlength=2))
    weights, offset = dual_coordinate_descent(
        [vectors[i] for i in chosen], 2.0 * labels[chosen] - 1, even[labels[chosen]])
    margins = np.array([float(weights[at] @ x) + offset for at, x in (vectors[i] for i in np.flatnonzero(held))])
    slope, level = calibrated(margins, labels[held], shares)
    return Model(ratios, weights, offset, slope, level)


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % 5


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Learn from the documents whose id has a label 0 or 1 and a ``remainder`` that is not 0."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(
        F.col("_label").isin(0, 1) & (remainder("_id") != 0))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes = np.zeros((BUCKETS, 2), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            label = np.array(batch.column("_label").to_pylist(), np.int64)
            for start, part in _parts(batch):
                text, at = features(part)
                own = label[start:start + len(part)]
                np.add.at(held, (at, own[text]), 1)
                sizes += np.bincount(own, minlength=2)
        at = np.flatnonzero(held.any(axis=1))
        # the sizes travel as one more bucket
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, BUCKETS).astype(np.int32)),
             *(pa.array(np.append(held[at, k], sizes[k])) for k in (0, 1))], ["bucket", "n0", "n1"])

    # labels grow with the documents, so few or many are joined alike: the labelled texts go to them
    with filtered_joins(spark):
        found = texts.join(known.hint("merge"), "_id").select("_label", "_text").mapInArrow(
            count, "bucket int, n0 long, n1 long").groupBy("bucket").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()  # at most BUCKETS + 1 rows
    counts = np.zeros((BUCKETS + 1, 2), np.int64)
    counts[found["bucket"].to_numpy(np.int64)] = found[["n0", "n1"]].to_numpy()

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in _parts(batch):
                text, at = features(part)
                border = pa.array(np.searchsorted(text, np.arange(len(part) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(start, len(part)) for c in ("_order", "_label")),
                     pa.ListArray.from_arrays(border, pa.array(at.astype(np.int32)))],
                    ["order", "label", "at"])

    # 2 * per_class rows at most, and one text for each
    order = F.xxhash64("_id").alias("_order")
    each = [known.where(F.col("_label") == k).select("_id", order, "_label").distinct().orderBy(
        "_order", "_id").limit(per_class) for k in (0, 1)]
    drawn = F.broadcast(each[0].unionByName(each[1]))
    rows = texts.join(drawn, "_id").mapInArrow(sampled, "order long, label int, at array<int>").groupBy(
        "order", "label").agg(F.min("at").alias("at")).toPandas().sort_values(["order", "label"])
    return fit([np.asarray(at, np.int64) for at in rows["at"]], rows["label"].to_numpy(np.int64),
               counts[:BUCKETS].astype(float), counts[BUCKETS])


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    start = 0
    for part in chunks(batch.column("_text").to_pylist()):
        yield start, part
        start += len(part)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    ``score`` is the probability of label 1, ``predicted`` 1 from ``threshold`` on, ``held_out`` whether labels
    of that id are never learned from. Null and empty texts have no features and get the score of the offset.
    With no labels of one kind (or too few to set some aside) every score is the smoothed share of label 1.
    Labels other than 0 and 1, and rows with a null id, are not learned from; of a repeated label or text all
    rows count. Repeated documents are scored alike. Other columns are ignored; an empty table gives an
    empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))

    def score(texts: list[str | None]) -> list[tuple]:
        found = chain.from_iterable(model.value.probabilities(part).tolist() for part in chunks(texts))
        return [(p, int(p >= threshold)) for p in found]

    scored = mapped(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), score,
                    "score double, predicted int")
    return scored.select("doc_id", F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out"),
                         "score", "predicted")
