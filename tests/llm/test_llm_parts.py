"""The parts that need no session, against plain versions and exact round trips."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skilltide.llm import bpe, exact, jaccard, langid, lexicon, losertree, pii, toxicity, urls, warc

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


@given(st.sets(st.integers(0, 1 << 40), min_size=1, max_size=200), st.integers(0, 36))
@settings(deadline=None, max_examples=60)
def test_rice_round_trip(values, k):
    ordered = np.array(sorted(values), np.int64)
    if (ordered[-1] >> k) > 1 << 20:
        return
    assert (exact.rice_decode(exact.rice_encode(ordered, k), len(ordered), k) == ordered).all()


@given(st.lists(st.lists(st.integers(0, 30)), max_size=9))
@settings(deadline=None)
def test_losers_merge_sorted_runs(runs):
    got = list(losertree.merge([sorted(r) for r in runs], key=lambda x: (x,)))
    assert got == sorted(x for r in runs for x in r)


@given(st.lists(st.integers(0, 9)))
def test_natural_runs(items):
    runs = losertree.natural_runs(items, key=lambda x: (x,))
    assert [x for r in runs for x in r] == items and all(r == sorted(r) for r in runs)


@given(st.dictionaries(st.binary(max_size=6), st.lists(st.integers(0, 60000), max_size=3), max_size=40))
@settings(deadline=None)
def test_lexicon(tmp_path_factory, words):
    path = tmp_path_factory.mktemp("lexicon") / "words.bin"
    path.write_bytes(lexicon.build(words))
    held = lexicon.Lexicon(str(path))
    assert all(held.get(w) == ids for w, ids in words.items())
    for other in (b"", b"a", b"zz", b"\x00\x01"):
        assert held.get(other) == words.get(other)


def test_lexicon_shares_suffixes(tmp_path):
    path = tmp_path / "words.bin"
    path.write_bytes(lexicon.build({f"{c}ation".encode(): [1] for c in "abcdefgh"}))
    assert lexicon.Lexicon(str(path)).states == 7


@pytest.fixture(scope="module")
def coder():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return bpe.Coder(bpe.Vocabulary(f.read()))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("text", [
    "", " ", "a", "It's  what\n\n we'll do, 123abc!", "<|endoftext|>x <|endoftext|>", "a" * 3000,
    "ab" * 500 + "é" * 200, "naïve 中文 १२ 😀 \x1c\x85 x", "\r\n\t  end  ", "''s 's'S",
])
def test_ids_as_the_library(coder, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert list(coder.encode(text)) == ids
    assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


@given(st.text(max_size=60))
@settings(deadline=None, max_examples=150)
def test_any_text_as_the_library(coder, library, text):
    assert list(coder.encode(text)) == library.encode(text, add_special_tokens=False).ids
    assert coder.decode(coder.encode(text)) == text


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15}[kind]():
                out.append((*m.span(), kind))
    return sorted(out)


def test_base_spans_against_the_patterns():
    r = random.Random(1)
    for _ in range(5000):
        text = "".join(r.choice("0123456789..@@+- ()ab") for _ in range(r.randrange(40)))
        assert sorted(pii.base_spans(text)) == plain_spans(text), text
    assert pii.base_spans("1" * 200_000 + "a@" * 1000) == []


@given(st.integers(0, 2000))
def test_windows_cover_the_text(length):
    text = "x" * length
    covered = {i for s, e in pii.windows(text) for i in range(s, e)}
    assert covered == set(range(length))


def test_every_place_is_decoded():
    text = "x" * 500 + "4" * 300 + "y" * 500 + "@" + "z" * 500 + " at " + "z" * 500
    covered = {i for s, e in pii.worth_decoding(text) for i in range(s, e)}
    assert covered >= {i for i, c in enumerate(text) if c in "4@ "}
    assert pii.worth_decoding("no such place") == [] and pii.worth_decoding("") == []


@pytest.mark.parametrize("text, kind, can", [
    ("jane.doe at mail dot example dot com", "email", True), ("a_at_b_dot_c", "email", True),
    ("a [AT] b.c", "email", True), ("a @ b . c", "email", True), ("look at that", "email", False),
    ("nobody", "email", False), ("-dot" * 5000 + " at a!", "email", False), ("10(.)0(.)0(.)1", "ip", True),
    ("10 . 0 . 0 . 256", "ip", False), ("4111/1111/1111/1111", "card", True),
    ("4111/1111/1111/1112", "card", False), ("030 123 4567", "phone", True), ("12345", "phone", False)])
def test_plausible(text, kind, can):
    assert pii.plausible(text, kind) == can
    assert not can or pii.PLACES.search(text)  # so windows without a place cannot hold one


def test_reconcile_keeps_clear_of_the_base_and_joins_pieces():
    text = "call 555-123-4567 or a@b.cd now"
    base = pii.base_spans(text)
    found = [(5, 12, "phone", 0.95), (10, 17, "phone", 0.9), (20, 26, "email", 0.99)]
    assert pii.reconcile(text, base, found) == [(5, 17, "phone")]
    assert pii.reconcile("", [], []) == []


def test_tagger_gradient():
    ids, gold = pii.examples(["mail to john.doe@example.com or +49 30 1234567 now, 10.0.0.1 as well"])
    tagger = pii.new_tagger()
    _, gradient = tagger.gradient(ids, gold)
    for name, g in gradient.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        value, losses = tagger.p[name][at], []
        for step in (1e-4, -1e-4):
            tagger.p[name][at] = value + step
            losses.append(tagger.gradient(ids, gold)[0])
        tagger.p[name][at] = value
        assert (losses[0] - losses[1]) / 2e-4 == pytest.approx(g[at], rel=1e-4)


def test_shingles_and_similarity():
    r = np.random.default_rng(2)
    texts = [r.integers(0, 6, n) for n in (0, 1, 4, 5, 30, 31, 60)]
    sets = [jaccard.shingles(t.astype(np.int64), 5) for t in texts]
    assert [len(s) for s in sets[:4]] == [0, 1, 1, 1]
    full = sets[1:]
    want = [[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8 for b in full] for a in full]
    assert (jaccard._linked(full, full, 0.8) == np.array(want)).all()


def test_bands_reach_the_recall():
    n = jaccard.bands_for(0.8, 5, 0.99999)
    assert 1 - (1 - 0.8 ** 5) ** n >= 0.99999 > 1 - (1 - 0.8 ** 5) ** (n - 1)


def test_segmentation_takes_the_likeliest_words():
    s = urls.Segmenter({"cheap": 50, "pills": 40, "the": 500, "ap": 2, "che": 1, "he": 90})
    assert s.split("cheappills") == ("cheap", "pills") and s.split("") == ()
    assert s.tokens("www2.cheap-pills.com", "/en/12.html")[-3:] == ["p:en", "p:0", "p:html"]


def test_ordinal_model_orders_severity():
    rows, grades = [], []
    for i in range(300):
        g = i % 3
        words = {"plain", "text", f"w{i % 7}"} | ({"vile"} if g else set()) | ({"worst"} if g == 2 else set())
        at = np.array(sorted(b for w in words for b in toxicity.buckets(w)))
        rows.append((at, np.ones(len(at))))
        grades.append(g)
    model = toxicity.fit(rows, grades, [1.0] * 300, 3)
    severity = [sum(model.probabilities(float(model.weights[at] @ x))) for at, x in rows[:3]]
    assert severity[0] < 0.5 < severity[1] < severity[2] and model.thresholds[0] <= model.thresholds[1]
    assert toxicity.fit([], [], [], 1).probabilities(0.0) == []


def test_temperature_softens_overconfident_scores():
    logits = np.array([[9.0, 0.0]] * 7 + [[0.0, 9.0]] * 3)
    assert langid.temperature(logits, np.zeros(10, np.int64)) > 5
    assert langid.temperature(np.zeros((0, 2)), np.zeros(0, np.int64)) == 1.0


def test_counts_over_pieces_are_those_of_the_whole(monkeypatch):
    text = "Straße und Ärger, été 2024! " * 30
    whole, _ = langid.counts(text)
    monkeypatch.setattr(langid, "PIECE", 37)
    assert (langid.counts(text)[0] == whole).all()
    assert langid.counts("12 ?")[1] is False and langid.counts(None)[1] is False


@pytest.mark.parametrize("url", [None, "", "http://a.b/\r\nX: y"])
def test_record_round_trip(url):
    import hashlib
    payload = "größe\r\n\r\n".encode() * 3
    digest = hashlib.sha256(payload).hexdigest()
    stored = warc.parse(warc.record(5, url, payload, digest, None, False))
    assert stored == {"page_id": 5, "payload_bytes": len(payload), "payload_digest": digest,
                      "record_type": "response", "refers_to": None}
    assert warc.parse(warc.record(None, url, payload, digest, 5, True))["refers_to"] == 5
    with pytest.raises(ValueError):
        warc.parse(warc.record(5, url, payload, "0" * 64, None, False))
