"""Repair of the structure of conversations: system?, then user and assistant in turn.

Every row has a fault (blank, duplicate, truncated) or none, and a role. One letter for both makes a signature of
each conversation. The distinct signatures of all conversations form a word graph that shares suffixes: a
node is a suffix of some signature, its edge leads to the suffix without the first letter. They are sorted by
their letters from the end, so each task meets the signatures of its range as a walk over the nodes, and every
node is entered once. On entry the cost to go and the first edit of the best audit suffix are worked out for every
state of the grammar, from those of the node it leads to; the audit of a signature is read along its nodes.

A signature is put together from pieces of a sort by conversation and turn, which Spark cuts into ranges
of equal size, so that no task gathers the rows of a large conversation. Only the digest of a repaired
conversation reads its rows one after the other, from a sorted stream.
"""

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skilltide.storage import settle

from .ship import ship

BLANK = " \t\n\x0b\x0c\r"
PIECE = 1 << 16  # rows whose letters travel together
DELETE, INSERT, KEEP, REROLE = "DIKR"
COST = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
CUT_SHORT = 5  # more for a truncated row that stays
ROLES = {"u": "user", "a": "assistant"}
# state -> role's initial -> next state: nothing yet, after system, after user, after assistant
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
WANTED = tuple(next(c for c in moves if c in ROLES) for moves in GRAMMAR)
GONE = "x"  # letter of a blank or repeated row; otherwise the role's initial or "o", a capital if truncated
MOST = 1 << 60

Node = tuple[tuple[int, ...], int, str]  # costs of the states above the least one, that one, first edits


def _with_insertions(best: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Best (cost, edit) of each state, when messages may be put in before."""
    for _ in GRAMMAR:
        best = [min(b, (best[GRAMMAR[q][WANTED[q]]][0] + COST[INSERT], INSERT)) for q, b in enumerate(best)]
    return best


def _node(best: list[tuple[int, str]], base: int) -> Node:
    least = min(c for c, _ in best)
    return tuple(c - least for c, _ in best), base + least, "".join(e or "." for _, e in best)


END = _node(_with_insertions([(0 if q in FINAL else MOST, "") for q in range(len(GRAMMAR))]), 0)


@lru_cache(maxsize=1 << 16)
def _entered(costs: tuple[int, ...], letter: str) -> Node:
    """The node of one more letter before a suffix with these costs. Edits differ in their letters, so
    of edits that cost the same the least one begins the least audit."""
    best = []
    for q, moves in enumerate(GRAMMAR):
        options = [(costs[q] + COST[DELETE], DELETE)]
        if letter != GONE:
            more = CUT_SHORT if letter.isupper() else 0
            if letter.lower() in moves:
                options.append((costs[moves[letter.lower()]] + COST[KEEP] + more, KEEP))
            options.append((costs[moves[WANTED[q]]] + COST[REROLE] + more, REROLE))
        best.append(min(options))
    return _node(_with_insertions(best), 0)


def enter(node: Node, letter: str) -> Node:
    costs, least, edits = _entered(node[0], letter)
    return costs, least + node[1], edits


def audit(signature: str, nodes: list[Node]) -> str:
    """The edits from the start of a signature, whose nodes are listed from the end."""
    out, state, row = [], 0, 0
    while True:
        edit = nodes[len(signature) - row][2][state]
        if edit == ".":
            return "".join(out)
        out.append(edit)
        if edit in (INSERT, REROLE):
            state = GRAMMAR[state][WANTED[state]]
        elif edit == KEEP:
            state = GRAMMAR[state][signature[row].lower()]
        row += edit != INSERT


def solved(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of distinct signatures."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, before = [END], ""
        for batch in batches:
            out = []
            for backwards in batch.column("backwards").to_pylist():
                shared = 0
                for x, y in zip(before, backwards):
                    if x != y:
                        break
                    shared += 1
                del nodes[shared + 1:]
                for letter in backwards[shared:]:
                    nodes.append(enter(nodes[-1], letter))
                before, signature = backwards, backwards[::-1]
                out.append((signature, nodes[-1][1] + nodes[-1][0][0], audit(signature, nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["signature", "cost", "audit"])

    backwards = signatures.select(F.reverse("signature").alias("backwards"))
    return backwards.repartitionByRange("backwards").sortWithinPartitions("backwards").mapInArrow(
        walk, "signature string, cost long, audit string")


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, n): the rows after damage by a hash of conversation and turn.

    ``n`` is 0 for a row that goes and 2 for one that comes twice. Null roles and texts are one space,
    and so are null numbers in what is hashed.
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", shown(conv_col), shown(turn_col))) % 20
    text = shown(text_col)
    return conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.when(kind == 4, "user").otherwise(shown(role_col)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("n"))


def _order(prefix: str = "") -> list[Column]:
    """Rows of a conversation: by turn, nulls first, then role and digest of the text."""
    return [F.col(prefix + c).asc_nulls_first() for c in ("turn", "role", "digest")]


def _units(rows: DataFrame) -> DataFrame:
    """Equal rows as one, with their number and letters."""
    trimmed = F.expr("rtrim(' \\t\\n\\u000b\\f\\r', text)")
    last = F.substring(trimmed, -1, 1)
    initial = F.substring("role", 1, 1)
    units = settle(rows.groupBy("conv_id", "turn", "role", F.sha2("text", 256).alias("digest")).agg(
        F.sum("n").alias("n"), F.first(trimmed == "").alias("blank"),
        F.first(~last.isin(".", "!", "?")).alias("truncated"),
        F.first(F.when(initial.isin("s", "u", "a"), initial).otherwise("o")).alias("initial")), "units")
    key = ("conv_id", "role", "digest")
    earliest = units.where("n > 0 and not blank").groupBy(*[F.col(c).alias(f"own_{c}") for c in key]).agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("least"))
    condition = [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in key]
    first = F.coalesce(F.col("least.turn").eqNullSafe(F.col("turn")) & ~F.col("blank"), F.lit(False))
    return units.join(earliest, condition, "left").select(
        "conv_id", "turn", "role", "digest", F.col("n").cast("long").alias("n"), "blank", "truncated", "initial",
        first.alias("first"))


def _pieces(units: DataFrame) -> DataFrame:
    """Letters and counts of runs of rows of a conversation."""
    names = ["at_turn", "at_role", "at_digest", "letters", "rows", "blank", "duplicate", "truncated", "illegal",
             "first", "last", "low", "high", "turns"]
    turn_type = units.schema["turn"].dataType.simpleString()
    schema = (f"conv_id {units.schema['conv_id'].dataType.simpleString()}, at_turn {turn_type}, at_role string, "
              "at_digest string, letters string, rows long, blank long, duplicate long, truncated long, "
              f"illegal long, first string, last string, low {turn_type}, high {turn_type}, turns long")
    legal = {a + b for a, b in ("su", "ua", "au")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, conv = None, None
        for batch in batches:
            done, columns = [], batch.to_pydict()
            for conv_id, turn, role, digest, n, blank, truncated, initial, first in zip(*columns.values()):
                if held is None or conv_id != conv or held["rows"] >= PIECE:
                    if held:
                        done.append((conv, held))
                    conv = conv_id
                    held = dict.fromkeys(names, 0) | {
                        "at_turn": turn, "at_role": role, "at_digest": digest, "letters": [], "first": None,
                        "last": None, "low": None, "high": None}
                if not n:
                    continue
                fresh = first and not blank
                letter = GONE if not fresh else initial.upper() if truncated else initial
                held["letters"].append(letter + GONE * (n - 1))
                held["blank"] += n if blank else 0
                held["duplicate"] += 0 if blank else n - fresh
                held["truncated"] += int(fresh and truncated)
                held["illegal"] += (n - 1) * (initial * 2 not in legal)
                if held["rows"]:
                    held["illegal"] += held["last"] + initial not in legal
                else:
                    held["first"] = initial
                held["rows"] += n
                held["last"] = initial
                if turn is not None and turn != held["high"]:
                    held["low"] = turn if held["low"] is None else held["low"]
                    held["high"] = turn
                    held["turns"] += 1
            yield emit(done, batch.schema)
            types = batch.schema
        if held:
            yield emit([(conv, held)], types)

    def emit(done: list, schema: pa.Schema) -> pa.RecordBatch:
        turn = schema.field("turn").type
        typed = {"at_turn": turn, "low": turn, "high": turn} | dict.fromkeys(
            ("at_role", "at_digest", "letters", "first", "last"), pa.string())
        columns = [pa.array([c for c, _ in done], schema.field("conv_id").type)]
        for name in names:
            values = [("".join(h[name]) if name == "letters" else h[name]) for _, h in done]
            columns.append(pa.array(values, typed.get(name, pa.int64())))
        return pa.RecordBatch.from_arrays(columns, ["conv_id", *names])

    order = [F.col("conv_id").asc_nulls_first(), *_order()]
    return units.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _signatures(pieces: DataFrame) -> DataFrame:
    """The pieces of each conversation put together; most have one."""
    at = F.struct(F.col("at_turn").isNotNull().alias("some"), "at_turn", "at_role", "at_digest").alias("at")
    piece = F.struct(at, *[c for c in pieces.columns if c != "conv_id" and not c.startswith("at_")])
    grouped = pieces.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")],
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.array_sort(F.filter(F.collect_list(piece), lambda p: p["rows"] > 0)).alias("pieces"))
    k = F.greatest(F.size("pieces") - 1, F.lit(0))

    def borders(test) -> Column:
        between = F.zip_with(F.slice("pieces", 1, k), F.slice("pieces", 2, k), test)
        return F.aggregate(between, F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x, F.lit(False)).cast("long"))

    return grouped.select(
        "conv_id", F.array_join("pieces.letters", "").alias("signature"), "blank", "duplicate", "truncated",
        (F.col("illegal") + borders(lambda a, b: ~F.concat(a["last"], b["first"]).isin("su", "ua", "au"))).alias(
            "illegal"),
        F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns") + borders(
            lambda a, b: a["high"] == b["low"]), F.lit(0)).cast("long").alias("gaps"))


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``damaged``: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``.

    Rows are taken by turn, nulls first, then by role and by SHA-256 of the text, and equal rows one after
    the other. ``audit`` has the initials of the cheapest edits (Delete, Insert, Keep, Rerole), the least
    in ASCII of several; the digest is of the repaired ``role:text`` lines. A conversation without rows has
    zeros, an empty audit and the digest of an empty string; a null ``conv_id`` is a conversation too.
    """
    ship(rows.sparkSession)
    units = settle(_units(rows), "letters")
    found = settle(_signatures(_pieces(units)), "signatures")
    best = solved(found.select("signature").distinct())
    heads = settle(found.join(best, "signature").drop("signature"), "audits")
    return _digested(rows.where("n > 0"), heads)


def repair_damaged(conversations: DataFrame, **columns: str) -> DataFrame:
    """``repaired`` of the rows after damage. Extra columns are ignored; an empty table gives an empty
    result."""
    return repaired(damaged(conversations, **columns))


def _digested(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Heads with the digest of the repaired conversation, from one stream of each head and its rows."""
    made = rows.select("conv_id", F.lit(1).alias("part"), "turn", "role", F.sha2("text", 256).alias("digest"), "n",
                       "text")
    both = heads.withColumn("part", F.lit(0)).unionByName(made, allowMissingColumns=True)
    order = [F.col("conv_id").asc_nulls_first(), F.col("part"), *_order()]
    columns = ["part", "role", "text", "n", *RESULT, "audit"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            done, kind = [], batch.schema.field("conv_id").type
            for conv, part, role, text, n, *head in zip(
                    *(batch.column(c).to_pylist() for c in ["conv_id", *columns])):
                if part == 0:
                    if held:
                        done.append(held.end())
                    held = _Repaired(conv, head)
                else:
                    for _ in range(n):
                        held.row(role, text)
            yield emit(done, kind)
        if held:
            yield emit([held.end()], kind)

    def emit(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * len(RESULT), pa.string(), pa.string()]
        values = zip(*done) if done else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)],
                                          ["conv_id", *RESULT, "audit", "repaired_sha256"])

    conv_type = heads.schema["conv_id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in RESULT)
    return both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", *columns).mapInArrow(
        stream, f"conv_id {conv_type}, {longs}, audit string, repaired_sha256 string")


class _Repaired:
    """The digest of a conversation, row by row."""

    def __init__(self, conv, head: list):
        self.conv, self.head, self.edits = conv, head, head[-1]
        self.at, self.state, self.lines, self.sha = 0, 0, 0, hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1
        self.state = GRAMMAR[self.state][role[0]]

    def _insertions(self) -> None:
        while self.edits[self.at:self.at + 1] == INSERT:
            self._line(ROLES[WANTED[self.state]], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insertions()
        edit = self.edits[self.at]
        self.at += 1
        if edit != DELETE:
            self._line(role if edit == KEEP else ROLES[WANTED[self.state]], text)

    def end(self) -> tuple:
        self._insertions()
        return (self.conv, *self.head, self.sha.hexdigest())
