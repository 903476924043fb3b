"""Repair of conversations against a search over all edits, and its SQL."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from checks.compare import connect, difference
from skilltide.llm import repair
from skilltide.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, part int, digest string, n string"
BLANK = "[^\\x20\\x09-\\x0D]"


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        out += [(conv, turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        marks = re.findall(BLANK, text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen
                   else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, lines) by Dijkstra's search over (row, roles so far), cheapest and then least first."""
    grammar = re.compile(r"(s?(ua)+)?")
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, lines = heapq.heappop(heap)
        if i == len(rows) and grammar.fullmatch(initials):
            return cost, audit, lines
        state = i, "" if not initials else initials[-1], len(initials) > 0
        if state in done:
            continue
        done.add(state)

        def put(more, edit, row, role, text):
            new = initials + role[:1]
            if role == "" or re.fullmatch(r"s?(ua)*u?", new) and new not in ("sa",):
                added = () if edit == "D" else (f"{role}:{text}",)
                heapq.heappush(heap, (cost + more, audit + edit, row, new, lines + added))

        for role in ("user", "assistant"):
            put(5, "I", i, role, "")
        if i < len(rows):
            _, _, role, text = rows[i]
            put(2, "D", i + 1, "", "")
            if found[i] in ("", "truncated"):
                more = 5 if found[i] else 0
                if role[:1] in ("s", "u", "a"):
                    put(more, "K", i + 1, role, text)
                for new in ("user", "assistant"):
                    put(more + 1, "R", i + 1, new, text)


def brute(table):
    """conv_id -> row of the operator."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = after_damage([r for r in table if r[0] == conv])
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
        found = faults(rows)
        turns = {r[1] for r in rows if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, lines = cheapest(rows, found)
        out[conv] = (gaps, *map(found.count, ("blank", "duplicate", "truncated")), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"],
                           r["repaired_sha256"]) for r in df.collect()}


def conversations(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "admin", " "]
    texts = ["Hello.", "Why?", "So it is!", "cut off", "", None, " \t\n", "Hello.", "é.", "end.\n ", ". ", "漢字"]
    out = []
    for conv in [*range(n), None, (1 << 60) + 1, (1 << 60) + 3]:
        for turn in range(rng.randint(1, 9)):
            out.append((conv, rng.choice([turn, turn, turn, turn + 5, None, turn - 2]), rng.choice(roles),
                        rng.choice(texts)))
    return out + out[:5]


@pytest.mark.parametrize("piece", [1 << 16, 2])
def test_against_search(spark, monkeypatch, piece):
    """Null, repeated and very large ids, null and tied turns, empty texts; also with short pieces."""
    monkeypatch.setattr(repair, "PIECE", piece)
    table = conversations(random.Random(5), 150)
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in table], SCHEMA).repartition(5)
    assert got(repair.repair_damaged(df)) == brute(table)


def test_every_signature_by_search():
    """All signatures of up to four letters: cost and audit, from shared suffixes as in a task."""
    letters = "suoASUx"
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for n in range(4):
        for signature in map("".join, itertools.product(letters, repeat=n)):
            nodes = [repair.END]
            for letter in reversed(signature):
                nodes.append(repair.enter(nodes[-1], letter))
            rows = [(0, i, names.get(c.lower(), "user"), str(i)) for i, c in enumerate(signature)]
            kinds = ["blank" if c == "x" else "truncated" if c.isupper() else "" for c in signature]
            cost, audit, _ = cheapest(rows, kinds)
            assert (nodes[-1][1] + nodes[-1][0][0], repair.audit(signature, nodes)) == (cost, audit), signature


def test_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i}.") for i in range(20_000)]
    rows += [(2, 7, "user", "Same.")] * 3000
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(16)
    found = got(repair.repair_damaged(df))
    lost = sum(zlib.crc32(f"1:{i}".encode()) % 20 == 0 for i in range(1, 19_999))
    assert found[1][0] == lost and len(found[1][6]) > 18_000
    k = zlib.crc32(b"2:7") % 20
    assert found[2][2] == {0: 0, 1: 0}.get(k, 3000 * (2 if k == 3 else 1) - 1)


def test_empty_and_wholly_dropped(spark):
    dropped = next((c, t) for c in range(100) for t in range(100) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(*dropped, "user", "x")], "conv_id long, turn long, role string, text string")
    none = hashlib.sha256(b"").hexdigest()
    result = repair.repair_damaged(df)
    assert got(result) == {dropped[0]: (0, 0, 0, 0, 0, 0, "", none)}
    empty = repair.repair_damaged(df.limit(0))
    assert empty.count() == 0 and empty.schema == result.schema


def test_query_against_search_and_sql(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    query = QUERIES["op12_conversation_repair"](spark, SMALL)
    assert got(query) == brute(table)
    assert difference(query, connect(SMALL), SQL["op12_conversation_repair"]) == ""
