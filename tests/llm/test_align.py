"""Token alignment against a comparison of all tokens, and the perfect hash."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from skilltide.llm import align, perfecthash
from skilltide.llm.bpe import byte_letters
from skilltide.llm.queries import QUERIES

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


def tokens(text):
    """(A ids, their bytes), (B ids, their bytes), by the two libraries."""
    a = Tokenizer.from_file(BYTES)
    a.no_truncation()
    a.no_padding()
    a.encode_special_tokens = True
    back = {c: b for b, c in enumerate(byte_letters())}
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    while True:
        if text:
            found = a.encode(" " + text, add_special_tokens=False)
            first = [(i, bytes(back[c] for c in t)) for i, t in zip(found.ids, found.tokens)]
            second = []
            for i in b.encode(text):
                piece = b.id_to_piece(i)
                raw = bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()
                second.append((i, raw))
            raw = (" " + text).encode()
            if raw == b"".join(x for _, x in first) == b"".join(x for _, x in second):
                text = yield first, second
                continue
        text = yield [], []


def spans(found):
    at, out = 0, []
    for i, raw in found:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(texts):
    """Rows of the operator without ids, by comparing every token of A with every token of B."""
    encoder = tokens(None)
    next(encoder)
    linked, documents, count = [], [], Counter()
    for text in texts:
        first, second = map(spans, encoder.send(text))
        links = [(i, j) for i, s, e in first for j, s2, e2 in second if s < e2 and s2 < e]
        linked.append(links)
        documents.append((first, second))
        count.update(set(links))
    best = Counter()
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for links, (first, second) in zip(linked, documents):
        cuts = sorted({e for *_, e in first} & {e for *_, e in second})
        shown, start = [], 0
        for cut in cuts:
            shown.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= cut)
                                  for side in (first, second)))
            start = cut
        groups = ";".join(shown)
        out.append((len(first), len(second), len(cuts), len(links),
                    sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), groups,
                    hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return out


def rows(df):
    return [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"],
             r["groups_sha256"]) for r in df.collect()]


ODD = ["", None, "a", " ", "  two  spaces ", "tab\tand\nline\r\n", "naïve café 漢字 \U0001f600", "▁lower block",
       "<|endoftext|> <s> </s> <unk> <0x41>", "a\0b", "repeat repeat", "repeat repeat", "x" * 300,
       "don't we'll I've", "12 345 6789", "  wide　", " " * 3000 + "after blanks", "﻿mark é"]


@pytest.mark.parametrize("fan,chunk,held", [(16, 1 << 20, 1 << 20), (2, 40, 8)])
def test_against_all_pairs(spark, monkeypatch, fan, chunk, held):
    """Nulls, empty, odd and repeated texts; also with a deep tree, small chunks and many hand-overs."""
    for name, value in (("FAN", fan), ("CHUNK_CHARACTERS", chunk), ("HELD_PAIRS", held), ("HELD_SEGMENTS", held)):
        monkeypatch.setattr(align, name, value)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab éè.,\n1漢") for _ in range(rng.randint(1, 60))) for _ in range(30)]
    docs = spark.createDataFrame([(i if i % 5 else None, t, "x", 1) for i, t in enumerate(texts)],
                                 "doc_id long, text string, keys string, task int").repartition(9)
    got = align.alignments(docs, BYTES, PIECES)
    assert sorted(rows(got)) == sorted(brute(texts))
    assert got.where("doc_id is null").count() == len(texts[::5])


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in docs if r["text"] is None or len(r["text"]) < 1500]
    table = spark.createDataFrame(short, "doc_id long, text string")
    got = align.alignments(table, BYTES, PIECES)
    assert sorted(rows(got)) == sorted(brute([r["text"] for r in short]))
    whole = QUERIES["op13_tokenizer_alignment"](spark, SMALL)
    assert sorted(r["doc_id"] for r in whole.collect()) == sorted(r["doc_id"] for r in docs)
    tree = {r["doc_id"]: r["groups_sha256"] for r in whole.collect()}
    assert all(tree[r["doc_id"]] == r["groups_sha256"] for r in got.collect())


def test_large_ids_and_empty_tables(spark):
    ids = [(1 << 60) + 1, (1 << 60) + 3, None]
    docs = spark.createDataFrame([(i, "some text") for i in ids], "doc_id long, text string").coalesce(1)
    got = align.alignments(docs, BYTES, PIECES)
    assert {r["doc_id"] for r in got.collect()} == set(ids)
    empty = align.alignments(docs.limit(0), BYTES, PIECES)
    assert empty.count() == 0 and empty.schema == got.schema
    blank = align.alignments(docs.selectExpr("doc_id", "cast(null as string) as text"), BYTES, PIECES)
    assert {tuple(r)[1:] for r in blank.collect()} == {(0, 0, 0, 0, 0, 0, "", "")}


def test_long_text(spark):
    text = "word and more " * 100_000
    docs = spark.createDataFrame([(1, text), (2, text[:-1])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in align.alignments(docs, BYTES, PIECES).collect()}
    assert got[1]["n_links"] == got[1]["n_a"] + got[1]["n_b"] - got[1]["n_groups"] > 300_000


@pytest.mark.parametrize("n", [0, 1, 2, 64, 5000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 40, 2 * n))[:n]
    table = perfecthash.PerfectHash(np.frombuffer(perfecthash.build(keys), np.int64))
    assert sorted(table.numbers(keys)) == list(range(len(keys)))
    others = np.setdiff1d(rng.integers(0, 1 << 40, 1000), keys)
    assert (table.numbers(others) == -1).all()


def test_perfect_hash_without_rows(monkeypatch):
    monkeypatch.setattr(perfecthash, "ROWS", 1)
    keys = np.arange(500) * 7
    table = perfecthash.PerfectHash(np.frombuffer(perfecthash.build(keys), np.int64))
    assert sorted(table.numbers(keys)) == list(range(500)) and len(table.rest)
    assert (table.numbers(keys + 1) == -1).all()
