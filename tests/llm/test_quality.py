"""Naive Bayes support vectors: features and training by plain Python, held-out accuracy, odd tables."""

import math
import zlib

import numpy as np
import pytest

from skilltide.llm import quality
from skilltide.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"
GOOD = ["This is a calm sentence number {} about rivers.", "We walked home, slowly, on day {}."]
BAD = ["BUY {} NOW!! BUY!! CHEAP!! DEAL!!", "menu | home | {} | links | next | prev |", "spam spam spam spam {}"]


def table(spark, n=400):
    docs, labels = [], []
    for i in range(n):
        kind = i % 2
        forms = GOOD if kind else BAD
        docs.append((i, forms[i // 2 % len(forms)].format(i) * (1 + i % 3), "en", 7, 9.0))
        labels.append((i, kind, 0))
    return (spark.createDataFrame(docs, "doc_id long, text string, label string, at int, score double"),
            spark.createDataFrame(labels, "doc_id long, quality int, text int"))


def test_features_one_by_one():
    texts = ["Big cats, big DOGS!! x1 x1", "", "one", "a_b _ é"]
    text, at = quality.features(texts)
    together = [set(at[text == i].tolist()) for i in range(len(texts))]
    alone = [set(quality.features([t])[1].tolist()) for t in texts]
    assert together == alone and not together[1]
    assert len(together[2]) == 2 and len(set(map(len, together))) > 2
    shapes = [quality.shape(t) for t in ("x", "X1", "WORD", "Word", "wOrd", "!", "!!", "?")]
    assert len(set(shapes)) == len(shapes) and quality.REPEATED not in shapes


def test_ratios_by_hand():
    counts = np.zeros((quality.BUCKETS, 2))
    counts[5], counts[9] = (3, 1), (0, 2)
    got = quality.log_count_ratios(counts)
    total = counts.sum(axis=0) + quality.BUCKETS
    assert got[5] == pytest.approx(math.log(2 / total[1]) - math.log(4 / total[0]))
    assert got[9] == pytest.approx(math.log(3 / total[1]) - math.log(1 / total[0])) and got[0] == 0


def test_dual_coordinate_descent_is_optimal():
    """No small step away from the weights lowers the objective."""
    rng = np.random.default_rng(1)
    rows = [(rng.choice(30, 5, replace=False), rng.normal(size=5)) for _ in range(60)]
    signs = np.where([x[1].sum() > 0 for x in rows], 1.0, -1.0)
    costs = np.full(60, 0.5)

    def objective(w, b):
        loss = sum(c * max(0, 1 - s * (w[at] @ x + b)) for (at, x), s, c in zip(rows, signs, costs))
        return (w @ w + b * b) / 2 + loss

    quality_epochs, quality.EPOCHS = quality.EPOCHS, 2000
    try:
        w, b = quality.dual_coordinate_descent(rows, signs, costs)
    finally:
        quality.EPOCHS = quality_epochs
    best = objective(w, b)
    for _ in range(200):
        d = np.zeros(quality.BUCKETS)
        d[:30] = rng.normal(size=30) * 1e-2
        assert objective(w + d, b + rng.normal() * 1e-2) > best - 1e-3
    found = [np.sign(w[at] @ x + b) for at, x in rows]
    assert (np.array(found) == signs).mean() > 0.9


def test_held_out_documents(spark):
    docs, labels = table(spark)
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == 400 and all(0 <= r["score"] <= 1 for r in got.values())
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert r["predicted"] == (r["score"] >= 0.3) == i % 2


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = table(spark)
    turned = labels.withColumn("quality", quality.F.when(quality.remainder("doc_id") == 0, 1 - quality.F.col(
        "quality")).otherwise(quality.F.col("quality")))
    first, second = (sorted(map(tuple, quality.quality_scores(docs, x).collect())) for x in (labels, turned))
    assert first == second


def test_model_by_plain_python(spark):
    """Counts, sample and scores of the jobs against loops over the rows."""
    docs, labels = table(spark, 120)
    label = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    counts, sizes = np.zeros((quality.BUCKETS, 2)), np.zeros(2)
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 5:
            counts[list(set(quality.features([text])[1].tolist())), label[i]] += 1
            sizes[label[i]] += 1
    model = quality.train(docs, labels)
    assert np.allclose(model.ratios, quality.log_count_ratios(counts))
    for i, text in rows[:20]:
        at = quality.features([text])[1]
        x = model.ratios[at]
        margin = float(model.weights[at] @ x) / math.sqrt(float(x @ x)) + model.offset
        assert model.probabilities([text])[0] == pytest.approx(
            1 / (1 + math.exp(-model.slope * margin - model.level)))


def test_odd_tables(spark):
    docs, labels = table(spark, 60)
    ids = [(1 << 60) + 1, (1 << 60) + 3, None, None, 0]
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, ["", None, " ", "x" * 200_000, GOOD[0]])],
                                docs.schema)
    more = labels.unionByName(spark.createDataFrame(
        [(None, 1, 0), ((1 << 60) + 1, None, 0), ((1 << 60) + 3, 7, 0), (2, 0, 0)], labels.schema))
    got = quality.quality_scores(docs.unionByName(odd), more)
    rows = got.collect()
    assert len(rows) == 65 and {r["doc_id"] for r in rows} >= set(ids)
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    blank = {r["score"] for r in rows if r["doc_id"] in ids[:2]}
    assert len(blank) == 1
    empty = quality.quality_scores(docs.limit(0), labels)
    assert empty.count() == 0 and empty.schema == got.schema
    unlabelled = quality.quality_scores(docs, labels.limit(0)).collect()
    assert {r["score"] for r in unlabelled} == {0.5} and len(unlabelled) == 60
    one_kind = quality.quality_scores(docs, labels.where("quality = 1")).select("score").distinct().collect()
    assert len(one_kind) == 1 and one_kind[0]["score"] > 0.9


def test_query_on_held_out_labels(spark):
    scored = QUERIES["op11_quality"](spark, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    wrong = [r for r in rows if r["predicted"] != r["quality"]]
    assert len(rows) > 40 and len(wrong) <= len(rows) // 20
    assert scored.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
