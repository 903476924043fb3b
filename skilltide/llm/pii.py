"""Personal data: fixed patterns, and a character BiLSTM-CRF that adds spans they miss.

The tagger learns from spans that the patterns label in a bounded sample of the windows of all documents,
and from the same windows with the spans rewritten in looser forms (``rewritten``). Overlapping windows cover
every whole text. A span that the tagger marks counts only if it is ``plausible``: numbers need digits, an
address an ``@`` or the word "at". So windows without any of these in reach need no decoding; all others
are decoded. Their spans are reconciled over the whole text: pieces cut at window edges are joined,
spans that overlap a pattern's are dropped, and of the rest the non-overlapping set of the highest
total score is taken.
"""

import hashlib
import heapq
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import zip_longest

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skilltide.storage import settle

from .rows import mapped
from .ship import ship
from .tagger import Lean, Tagger, classes

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
WINDOW, STRIDE, REACH = 192, 128, 64  # of decoding
PADDED = 32  # shorter windows are filled up to a multiple
TRAIN_WINDOWS, TRAIN_WINDOW, MARGIN = 480, 48, 24
EPOCHS = 10
CERTAIN = 0.8
BATCH = 256
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match never starts inside a run of digits, so the look-behind only saves repeated scans
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBERED = re.compile("[0-9@]")
PLACES = re.compile(r"[0-9@]|[\W_](?:at|AT|At|aT)[\W_]")
# words for the marks of an address, within any other marks
SPELLED = ((re.compile(r"[\W_]{1,3}at[\W_]{1,3}", re.IGNORECASE), "@"),
           (re.compile(r"[\W_]{1,3}dot[\W_]{1,3}", re.IGNORECASE), "."))
LOOSE_EMAIL = re.compile(r"[\w.%+-]+\s?@\s?[\w-]+(?:\s?\.\s?[\w-]+)+")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the patterns: leftmost, without overlap within a kind, failing ones dropped."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            out.append((start, done, "email"))
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(map(_byte, m.group().split("."))):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((*m.span(), "phone"))
    return out


def listed(spans: list[Span]) -> str:
    """kind:start:end by start, then kind as in KINDS, comma-joined."""
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


def windows(text: str, size: int = WINDOW, stride: int = STRIDE) -> list[tuple[int, int]]:
    """Overlapping windows that cover the text."""
    last = max(len(text) - size, 0)
    starts = range(0, last + stride, stride) if last else range(bool(text))
    return [(min(start, last), min(start, last) + min(size, len(text))) for start in starts]


def worth_decoding(text: str) -> list[tuple[int, int]]:
    """The windows that reach, by REACH characters, something without which no span is plausible."""
    places = [m.start() for m in PLACES.finditer(text)]
    return [(start, end) for start, end in windows(text)
            if bisect_left(places, start - REACH) < bisect_left(places, end + REACH)] if places else []


def plausible(text: str, kind: str) -> bool:
    """Whether a string that the tagger marked can be such a thing at all."""
    digits = _digits(text)
    if kind == "email":
        for spelled, mark in SPELLED:
            text = spelled.sub(mark, text)
        return bool(LOOSE_EMAIL.fullmatch(text))
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(map(_byte, parts)) and len(digits) < len(text)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    grouped = len(re.findall("[0-9]+", text)) > 1
    return 8 <= len(digits) <= 15 and grouped and not plausible(text, "ip")


def reconcile(text: str, base: list[Span], found: list[tuple[int, int, str, float]]) -> list[Span]:
    """The spans to add: joined at window edges, clear of the base, best total score."""
    joined: dict[tuple[int, int, str], float] = {}
    for kind in KINDS:
        run: list = []
        for start, end, _, score in sorted(f for f in found if f[2] == kind):
            if run and start < run[1]:  # parts of one span seen from two windows
                run = [run[0], max(run[1], end), max(run[2], score)]
            else:
                if run:
                    joined[run[0], run[1], kind] = run[2]
                run = [start, end, score]
        if run:
            joined[run[0], run[1], kind] = run[2]
    taken = sorted((s, e) for s, e, _ in base)
    starts, reach, furthest = [s for s, _ in taken], [], 0
    for _, end in taken:
        furthest = max(furthest, end)
        reach.append(furthest)

    def clear(start: int, end: int) -> bool:
        i = bisect_right(starts, end - 1)
        return i == 0 or reach[i - 1] <= start

    free = sorted(((e, s, kind, score) for (s, e, kind), score in joined.items()
                   if score >= CERTAIN and clear(s, e) and plausible(text[s:e], kind)))
    ends = [f[0] for f in free]
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)]  # weighted interval scheduling
    for i, (end, start, _, score) in enumerate(free):
        before = bisect_right(ends, start, 0, i)
        take = best[before][0] + score * (end - start)
        best.append((take, before, True) if take > best[i][0] else (best[i][0], i, False))
    out, i = [], len(free)
    while i:
        _, before, took = best[i]
        if took:
            out.append((free[i - 1][1], free[i - 1][0], free[i - 1][2]))
        i = before
    return out


def rewritten(kind: str, text: str, r: random.Random) -> str:
    """The same thing in a form the patterns miss."""
    if kind == "email":
        left, right = r.choice(["[]", "()", "{}", "<>", "__", "--", "  ", "  "])
        space = "" if left in " _-" else r.choice(["", " "])
        at, dot = (f"{space}{left}{r.choice([word, word.upper()])}{right}{space}" for word in ("at", "dot"))
        if left != " " and r.random() < 0.4:
            dot = "."
        local, _, domain = text.partition("@")
        return local + r.choice([at, at, at, " @ "]) + domain.replace(".", dot)
    if kind == "ip":
        return text.replace(".", r.choice(["[.]", " . ", "(.)"]))
    digits = _digits(text)
    if kind == "card":
        mark = r.choice([".", "  ", "/"])
        return mark.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    body = digits[-9:]
    return r.choice(["({}) {}-{}", "0{} {} {}", "00{} {} {}", "{}-{}-{}", "{}.{}.{}"]).format(
        body[:3], body[3:6], body[6:])


def examples(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Classes and labels of the texts: as they are, and with their spans rewritten."""
    r = random.Random(9)
    inputs, golds = [], []
    for text in texts:
        base = sorted(base_spans(text))
        clear = [s for i, s in enumerate(base) if all(
            s[1] <= o[0] or o[1] <= s[0] for j, o in enumerate(base) if i != j)]
        for loose in (False, True):
            if loose and not clear:
                continue
            pieces, spans, at, length = [], [], 0, 0
            for start, end, kind in clear:
                middle = text[start:end]
                if loose and r.random() < 0.8:
                    middle = rewritten(kind, middle, r)
                pieces += [text[at:start], middle]
                begin = length + start - at
                spans.append((begin, begin + len(middle), kind))
                length, at = begin + len(middle), end
            whole = "".join(pieces) + text[at:]
            labels = np.zeros(len(whole), np.int64)
            for start, end, kind in spans:
                labels[start:end] = 2 + 2 * KINDS.index(kind)
                labels[start] -= 1
            inputs.append(classes(whole))
            golds.append(labels)
    size = padded(max(map(len, inputs), default=0))
    return tuple(np.array([np.pad(row, (0, size - len(row))) for row in rows], np.int64).reshape(-1, size)
                 for rows in (inputs, golds))


def padded(length: int) -> int:
    return -(-length // PADDED) * PADDED


def new_tagger() -> Tagger:
    allowed = np.ones((LABELS, LABELS), bool)
    for kind in range(len(KINDS)):
        inside = 2 + 2 * kind
        allowed[:, inside] = False
        allowed[[inside - 1, inside], inside] = True
    return Tagger(LABELS, allowed)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          train_windows: int = TRAIN_WINDOWS) -> Tagger | None:
    """Learn from the windows that come first by a hash, of all windows of all documents: three fifths
    labelled, as evenly over the kinds as there are any, a fifth with digits or ``@`` but without a label, a
    fifth without either. None without any example."""

    ship(docs.sparkSession)
    labelled = train_windows * 3 // 5
    bounds = {**dict.fromkeys(KINDS, labelled), "numbered": train_windows // 5, "plain": train_windows // 5}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The first windows of a task, for each kind and without."""
        kept: dict[str, list] = {kind: [] for kind in bounds}
        for pdf in batches:
            for order, text in zip(pdf["order"], pdf["_text"]):
                ends: dict[str, tuple[list[int], list[int]]] = {}
                for s, e, kind in base_spans(text):  # in order within a kind
                    starts, stops = ends.setdefault(kind, ([], []))
                    starts.append(s)
                    stops.append(e)
                for start, end in windows(text, TRAIN_WINDOW, TRAIN_WINDOW):
                    lo, hi = max(0, start - MARGIN), min(len(text), end + MARGIN)
                    shown = [kind for kind, (starts, stops) in ends.items()
                             if bisect_right(stops, lo) < bisect_left(starts, hi)]
                    digest = hashlib.blake2b(b"%d:%d" % (order, start), digest_size=7).digest()
                    entry = (-int.from_bytes(digest, "big"), text[lo:hi])
                    for kind in shown or ["numbered" if NUMBERED.search(text, lo, hi) else "plain"]:
                        part, full = kept[kind], len(kept[kind]) >= bounds[kind]
                        if full and not (part and entry > part[0]) or entry in part:
                            continue
                        (heapq.heapreplace if full else heapq.heappush)(part, entry)
        yield pd.DataFrame([(kind, -key, piece) for kind, part in kept.items() for key, piece in part],
                           columns=["kind", "key", "piece"])

    drawn = settle(docs.select(F.xxhash64(id_col, F.lit(3)).alias("order"), F.col(text_col).alias("_text")).where(
        "_text <> ''").mapInPandas(cut, "kind string, key long, piece string"), "windows")
    first = {kind: drawn.where(F.col("kind") == kind).select("key", "piece").distinct().orderBy(
        "key", "piece").limit(n).collect() for kind, n in bounds.items()}
    # the kinds take turns, and a window of several kinds is taken once
    turns = dict.fromkeys(row for turn in zip_longest(*[first[k] for k in KINDS]) for row in turn if row)
    rows = [*list(turns)[:labelled], *first["numbered"], *first["plain"]]
    if not turns:
        return None
    ids, gold = examples([row["piece"] for row in rows])
    tagger = new_tagger()
    tagger.fit(ids, gold, EPOCHS)
    return tagger


def tagged(tagger: Tagger, texts: list[str], lean: Lean | None = None,
           chosen: Callable[[str], list[tuple[int, int]]] = worth_decoding) -> list[list[tuple[int, int, str, float]]]:
    """Spans (start, end, kind, score) that the windows of each text show, whatever they are batched with."""
    out: list[list] = [[] for _ in texts]
    lean = lean or tagger.lean()
    waiting: dict[int, list[tuple[int, int, np.ndarray]]] = {}

    def decode(part: list[tuple[int, int, np.ndarray]], size: int) -> None:
        ids = np.zeros((len(part), size), np.int64)
        for row, (_, _, window) in zip(ids, part):
            row[:len(window)] = window
        for at, path, p in zip(*tagger.decode(ids, lean)):
            i, start, window = part[at]
            for b in np.flatnonzero(path[:len(window)] % 2 == 1):
                e = b + 1
                while e < len(window) and path[e] == path[b] + 1:
                    e += 1
                out[i].append((start + int(b), start + int(e), KINDS[(path[b] - 1) // 2], float(p[b:e].mean())))

    for i, text in enumerate(texts):
        for start, end in chosen(text):
            size = padded(end - start)
            part = waiting.setdefault(size, [])
            part.append((i, start, classes(text[start:end])))
            if len(part) == BATCH:
                decode(part, size)
                part.clear()
    for size, part in waiting.items():
        if part:
            decode(part, size)
    return out


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added``.

    Counts and digest are of the patterns' spans; ``spans`` has those and the tagger's, ``n_added`` the
    number of the latter. Null counts as empty and has none. Offsets are code points. Where no text
    shows anything to learn from, nothing is added. Repeated rows are judged alike, ids may be null;
    other columns are ignored.
    """
    tagger = train(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((tagger, tagger.lean()) if tagger else None)
    names = [f"n_{k}" for k in KINDS]

    def find(all_texts: list[str | None]) -> list[tuple]:
        nothing = (*[0] * len(KINDS), hashlib.sha256(b"").hexdigest(), "", 0)
        out = [nothing] * len(all_texts)
        some = [i for i, text in enumerate(all_texts) if text]
        texts = [all_texts[i] for i in some]
        bases = [base_spans(t) for t in texts]
        found = [[] for _ in texts]
        if shared.value:
            tagger, lean = shared.value
            found = tagged(tagger, texts, lean)
        for i, text, base, more in zip(some, texts, bases, found):
            added = reconcile(text, base, more)
            counts = [sum(s[2] == k for s in base) for k in KINDS]
            digest = hashlib.sha256(listed(base).encode()).hexdigest()
            out[i] = (*counts, digest, listed(base + added), len(added))
        return out

    return mapped(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), find,
                  ", ".join(f"{n} long" for n in names) + ", base_sha256 string, spans string, n_added long")
