"""What Python workers hold on to, and for how long."""

import gc
import tracemalloc
import weakref

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from skilltide.llm import bpe, jaccard, kept


@pytest.fixture
def content(monkeypatch):
    monkeypatch.setattr(bpe, "Lexicon", lambda path: None)
    monkeypatch.setattr(bpe.SparkFiles, "get", lambda name: name)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        yield f.read()
    kept.forget()


def test_one_coder_at_a_time(content):
    first = bpe._worker_coder("first", content)
    first.encode("some words")
    assert bpe._worker_coder("first", content) is first  # a later task of the job finds its words
    gone = weakref.ref(first)
    del first
    bpe._worker_coder("second", content)
    gc.collect()
    assert gone() is None


def test_another_operator_frees_the_coder(content):
    gone = weakref.ref(bpe._worker_coder("first", content))
    list(jaccard._signer(5, 2, 2)(iter(())))
    gc.collect()
    assert gone() is None


def test_ids_of_a_word_take_four_bytes(content):
    coder = bpe._worker_coder("first", content)
    ids = coder.encode("unforgettable" * 3)
    assert len(ids) > 3 and [len(x) for x in coder.words.values()] == [4 * len(ids)]


def test_pairs_of_a_block_are_not_listed():
    n = 1500
    rows = pd.DataFrame({
        "member": range(n), "weight": 1, "block": 0, "part_a": 0, "part_b": 0, "head": 0,
        "here": [np.array([7])] * n, "shingles": [np.arange(3)] * n, "buckets": [np.array([7])] * n})
    verify = jaccard._verifier(0.8)
    tracemalloc.start()
    try:
        found = pd.concat(verify(iter([rows])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert set(found["links"]) == {n - 1} and set(found["root"]) == {0}
    assert peak < 8 * n * (n - 1) / 2  # of two 64-bit numbers a pair


def test_a_bucket_joins_all_its_links_and_counts_its_own():
    """Counted in bucket 3, the links of 5 still hang its members on one root, which saves rounds."""
    base = np.arange(100)
    buckets = [[3, 5], [3, 5], [5], [3, 5, 9]]
    rows = pd.DataFrame({
        "member": [5, 6, 7, 8], "weight": [1, 10, 100, 1000], "block": 0, "part_a": 0, "part_b": 0, "head": 5,
        "here": [np.array([5])] * 4, "shingles": [np.append(base, 1000 + i) for i in range(4)],
        "buckets": [np.array(x) for x in buckets]})
    found = pd.concat(jaccard._verifier(0.8)(iter([rows])))
    assert sorted(map(tuple, found[["member", "links", "root"]].to_numpy().tolist())) == [
        (5, 100, 5), (6, 100, 5), (7, 1011, 5), (8, 100, 5)]
    rows["buckets"] = [np.array([3, 5])] * 4
    found = pd.concat(jaccard._verifier(0.8)(iter([rows])))
    assert sorted(map(tuple, found[["member", "links", "root"]].to_numpy().tolist())) == [
        (6, 0, 5), (7, 0, 5), (8, 0, 5)]


def test_two_blocks_by_pairs():
    """Blocks of a bucket, one with another: as counted pair by pair."""
    r = np.random.default_rng(5)
    n = 60
    sets = [np.unique(np.append(r.choice(np.arange(40), 37, False), 100 + r.integers(0, 3))) for _ in range(n)]
    buckets = [np.array(sorted(set(r.choice([2, 3, 4], 1).tolist() + [6]))) for _ in range(n)]
    weight, block = r.integers(1, 5, n), np.repeat([0, 1], n // 2)
    want = dict.fromkeys(range(10, 10 + n), 0)
    for a in range(n):
        for b in range(a):
            common = len(np.intersect1d(sets[a], sets[b]))
            if block[a] != block[b] and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common) and (
                    min(set(buckets[a]) & set(buckets[b])) == 6):
                want[10 + a] += weight[b]
                want[10 + b] += weight[a]
    found = pd.concat(jaccard._verifier(0.8)(iter([pd.DataFrame({
        "member": range(10, 10 + n), "weight": weight, "block": block, "part_a": 0, "part_b": 1, "head": 6,
        "here": [np.array([6])] * n, "shingles": sets, "buckets": buckets})])))
    got = dict(zip(found["member"], found["links"]))
    assert any(want.values()) and {m: got.get(m, 0) for m in want} == want
