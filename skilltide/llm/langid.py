"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams over lower-cased letters, other characters being one space.
Document frequencies are counted over all documents to learn from. The regression is trained by
follow-the-regularised-leader with an elastic net, on a bounded sample of them (``per_language`` rows
of each language, chosen by a hash of their id); a fifth of the sample fits the temperature.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kept import forget
from .ship import ship

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
PER_LANGUAGE = 500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.002
PIECE = 1 << 20  # characters turned into n-grams at a time

_table: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """Code point -> code of its lower-case letter, or of the space."""
    if not _table:
        table = np.full(0x110000, 32, np.int32)
        for c in range(0x110000):
            if chr(c).isalpha():
                table[c] = ord(chr(c).lower()[0])
        _table.append(table)
    return _table[0]


def counts(text: str | None) -> tuple[np.ndarray, bool]:
    """Counts per bucket over a whole text, and whether it has a letter."""
    out = np.zeros(BUCKETS, np.int64)
    text = text or ""
    letters = False
    reach = max(ORDERS) - 1
    for start in range(0, len(text), PIECE):
        piece = text[start:start + PIECE + reach]
        raw = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = _folded()[np.minimum(raw, 0x10FFFF)].astype(np.uint32)
        letters = letters or bool((codes != 32).any())
        gram = np.zeros(len(codes), np.uint32)
        fresh = min(PIECE, len(text) - start)  # n-grams that begin in this piece
        for n in range(1, max(ORDERS) + 1):
            if len(codes) < n:
                break
            gram = (gram[:len(codes) - n + 1] * np.uint32(0x01000193)) ^ codes[n - 1:]
            if n in ORDERS:
                mixed = ((gram + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(18)
                out += np.bincount(mixed[:fresh], minlength=BUCKETS)
    return out, letters


class Weights:
    """Buckets x languages, mostly zero: the others by bucket."""

    def __init__(self, dense: np.ndarray):
        rows, self.languages = np.nonzero(dense)
        self.values = dense[rows, self.languages]
        self.begins = np.searchsorted(rows, np.arange(dense.shape[0] + 1))
        self.width = dense.shape[1]

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        sizes = self.begins[at + 1] - self.begins[at]
        held = np.repeat(self.begins[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return np.bincount(self.languages[held], weights=self.values[held] * np.repeat(x, sizes),
                           minlength=self.width)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: Weights
    temperature: float

    def vector(self, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(count)
        x = np.log1p(count[at]) * self.idf[at]
        norm = math.sqrt(float(x @ x))
        return at, x / norm if norm else x

    def predict(self, text: str | None) -> tuple[str, float]:
        count, letters = counts(text)
        if not letters or not self.languages:
            return "und", 0.0
        at, x = self.vector(count)
        p = _softmax(self.weights.logits(at, x) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int) -> np.ndarray:
    """Weights of the softmax regression after EPOCHS passes of FTRL-proximal."""
    z = np.zeros((BUCKETS, classes))
    n = np.zeros((BUCKETS, classes))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zs) * L1 - zs
        return np.where(np.abs(zs) <= L1, 0.0, shrunk / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    order = np.random.default_rng(4)
    for _ in range(EPOCHS):
        for i in order.permutation(len(vectors)):
            at, x = vectors[i]
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            error = _softmax(x @ w)
            error[labels[i]] -= 1.0
            g = x[:, None] * error
            grown = ns + g * g
            z[at] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / ALPHA * w
            n[at] = grown
    return weights(z, n)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by a golden-section search."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        z = logits / math.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(labels)), labels]).mean())

    lo, hi = math.log(0.2), math.log(20.0)
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % 4


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the rows with a text and a language whose ``remainder`` is not 2."""
    ship(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                        F.col(lang_col).alias("_lang")).where(
        F.col("_text").isNotNull() & F.col("_lang").isNotNull() & (remainder("_id") != 2))
    sizes = known.groupBy("_lang").count().collect()
    languages = sorted(r["_lang"] for r in sizes)
    empty = Model(languages, np.ones(BUCKETS), Weights(np.zeros((BUCKETS, len(languages)))), 1.0)
    if not languages:
        return empty

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        found = np.zeros(BUCKETS, np.int64)
        for pdf in batches:
            for text in pdf["_text"]:
                found += counts(text)[0] > 0
        at = np.flatnonzero(found)
        yield pd.DataFrame({"bucket": at, "df": found[at]})

    df = known.select("_text").mapInPandas(frequencies, "bucket int, df long").groupBy("bucket").agg(
        F.sum("df").alias("df")).toPandas()  # at most BUCKETS rows
    frequency = np.zeros(BUCKETS)
    frequency[df["bucket"]] = df["df"]
    total = sum(r["count"] for r in sizes)
    empty.idf = np.log((1 + total) / (1 + frequency)) + 1

    # the share of each language that gives about ``per_language`` rows, by a hash of the id
    draw = F.pmod(F.xxhash64("_id"), F.lit(1 << 20))
    share = F.create_map(*[x for r in sizes for x in (
        F.lit(r["_lang"]), F.lit(math.ceil((1 << 20) * min(1.0, per_language / r["count"]))))])
    sample = known.where(draw < share[F.col("_lang")]).select(
        "_lang", F.xxhash64("_id", F.lit(1)).alias("order"), "_text")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for lang, order, text in zip(pdf["_lang"], pdf["order"], pdf["_text"]):
                count, _ = counts(text)
                at = np.flatnonzero(count)
                out.append((lang, order, at.astype(np.int32), np.minimum(count[at], 1 << 30).astype(np.int32)))
            yield pd.DataFrame(out, columns=["lang", "order", "at", "n"])

    rows = sample.mapInPandas(
        features, "lang string, order long, at array<int>, n array<int>").toPandas().sort_values("order")
    vectors, labels, number = [], [], {lang: i for i, lang in enumerate(languages)}
    for lang, at, n in zip(rows["lang"], rows["at"], rows["n"]):
        count = np.zeros(BUCKETS, np.int64)
        count[np.asarray(at, np.int64)] = n
        vectors.append(empty.vector(count))
        labels.append(number[lang])
    labels = np.array(labels, np.int64)
    calibrating = (rows["order"].to_numpy() % 5 == 0) & (len(labels) >= 50)
    chosen = np.flatnonzero(~calibrating)
    weights = ftrl([vectors[i] for i in chosen], labels[chosen], len(languages))
    held = np.flatnonzero(calibrating)
    logits = np.array([vectors[i][1] @ weights[vectors[i][0]] for i in held]).reshape(
        len(held), len(languages))
    return Model(languages, empty.idf, Weights(weights), temperature(logits, labels[held]))


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Struct column (lang, score) for a text column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        forget()
        own = shared.value
        return pd.DataFrame([own.predict(t) for t in texts], columns=["lang", "score"])

    return predict(F.col(text_col))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    A null text and a text without a letter give ``und`` with score 0; so does every text when there
    is nothing to learn from. Rows with a null id are not learned from and not held out. Repeated
    rows are predicted alike. Every language is learned.
    """
    model = train(docs, id_col, text_col, lang_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(remainder(id_col) == 2, F.lit(False)).alias("held_out"),
        predicted(docs, model, text_col).alias("p"),
    ).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def in_known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      lang_col: str = "lang") -> DataFrame:
    """The documents, with all their columns, whose language is recognised: those that are not ``und``."""
    model = train(docs, id_col, text_col, lang_col)
    judged = docs.select(F.struct("*").alias("row"), predicted(docs, model, text_col).alias("p"))
    return judged.where(F.col("p.lang") != "und").select("row.*")
