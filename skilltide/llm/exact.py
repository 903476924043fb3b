"""Exact deduplication with a Golomb-coded fingerprint exchange.

1. Every partition of the input is a *sender*. It sorts the distinct fingerprints of its rows and
   sends each *owner* (a range of the fingerprint space) its share, Golomb-Rice coded.
2. An owner decodes what it received and answers each sender with a bitmap: bit i is set when the
   i-th fingerprint of that message is also in the message of another sender.
3. Senders mark the rows whose bit is set, and rows that repeat a fingerprint of their own
   partition, as suspects. Only suspects' texts are shuffled; they are grouped by their bytes, with
   partial aggregation, so a text that fills a third of the table is one row per map task.

Fingerprints are shortened to ``log2(rows) + SLACK_BITS`` bits, so about one row in 2**SLACK_BITS is
a suspect without a copy; the byte comparison clears it.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skilltide.storage import settle

from .kept import forget
from .rows import filtered_joins, packed, same, text_key
from .ship import ship

SLACK_BITS = 10
ROWS_PER_OWNER = 1 << 16


def rice_encode(values: np.ndarray, k: int) -> bytes:
    """Golomb-Rice code (divisor 2**k) of the gaps between sorted, distinct values.

    Layout: bytes of the unary part (4), the unary quotients, then k-bit remainders.
    """
    gaps = np.diff(values, prepend=0).astype(np.int64)
    quotients = gaps >> k
    unary = np.zeros(int(quotients.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    head = np.packbits(unary).tobytes()
    shifts = np.arange(k - 1, -1, -1)
    tail = np.packbits(((gaps[:, None] >> shifts) & 1).astype(np.uint8).ravel()).tobytes()
    return len(head).to_bytes(4, "little") + head + tail


def rice_decode(blob: bytes, n: int, k: int) -> np.ndarray:
    head = int.from_bytes(blob[:4], "little")
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, head, 4)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    gaps = quotients.astype(np.int64) << k
    if k:
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, -1, 4 + head))[:n * k]
        gaps += bits.reshape(n, k).astype(np.int64) @ (1 << np.arange(k - 1, -1, -1))
    return np.cumsum(gaps)


def suspects(prints: DataFrame, rows: int) -> DataFrame:
    """(sender, print) of fingerprints found with another sender. ``prints``: distinct (sender, h)."""
    bits = min(62, max(1, math.ceil(math.log2(rows + 1)) + SLACK_BITS))
    owners = 1 << max(0, math.ceil(math.log2(max(1, rows / ROWS_PER_OWNER))))
    span = (1 << bits) // owners  # fingerprints of an owner
    shortened = prints.select(
        "sender", F.shiftrightunsigned("h", 64 - bits).alias("print")).distinct()

    def parameter(n: int) -> int:
        return max(0, int(math.log2(span / n * math.log(2)))) if span > n else 0

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        forget()
        values = np.sort(pdf["print"].to_numpy())
        own = values // span
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        out = []
        for part in np.split(values, starts[1:]):
            owner = int(part[0] // span)
            code = rice_encode(part - owner * span, parameter(len(part)))
            out.append((int(pdf["sender"].iloc[0]), owner, len(part), code))
        return pd.DataFrame(out, columns=["sender", "owner", "n", "code"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [rice_decode(c, n, parameter(n)) for c, n in zip(pdf["code"], pdf["n"])]
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        repeated = values[counts > 1]
        maps = [np.packbits(np.isin(p, repeated, assume_unique=True)).tobytes() for p in parts]
        return pd.DataFrame({"sender": pdf["sender"], "owner": pdf["owner"], "bitmap": maps})

    def mark(key: tuple, own: pd.DataFrame, maps: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(own["print"].to_numpy())
        hits = [np.empty(0, np.int64)]
        for owner, bitmap in zip(maps["owner"], maps["bitmap"]):
            lo, hi = np.searchsorted(values, [owner * span, (owner + 1) * span])
            flags = np.unpackbits(np.frombuffer(bitmap, np.uint8))[:hi - lo].astype(bool)
            hits.append(values[lo:hi][flags])
        return pd.DataFrame({"sender": key[0], "print": np.concatenate(hits)})

    sent = shortened.groupBy("sender").applyInPandas(
        send, "sender int, owner long, n int, code binary")
    answers = sent.groupBy("owner").applyInPandas(
        answer, "sender int, owner long, bitmap binary")
    marked = shortened.groupBy("sender").cogroup(answers.groupBy("sender")).applyInPandas(
        mark, "sender int, print long")
    return marked.select(F.col("sender"), F.col("print"), F.lit(bits).alias("bits"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after every run of space, tab, line feed, vertical tab, form feed
    and carriage return is replaced by one space; null counts as empty. Of equal texts the row with
    the smallest id stays (null ids last); of rows that share that id as well, exactly one. Empty
    texts are equal to each other. An empty table gives an empty result. Other columns are ignored.
    """
    return _judged(docs, id_col, text_col).drop("text_key")


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    normal = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    narrow = docs.select(F.col(id_col).alias("doc_id"), normal.alias("normal"),
                         text_key(F.col(text_col)).alias("text_key"))
    rows = settle(narrow.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text_key",
        F.sha2("normal", 256).alias("text_sha256"), F.xxhash64("normal").alias("h"),
    ).withColumn("sender", F.shiftright("row", 33).cast("int")), "exact-rows")
    total = rows.count()
    prints = rows.groupBy("sender", "h").agg(F.count("*").alias("n"))
    marked = settle(suspects(prints.select("sender", "h"), total), "exact-suspects")
    bits = min(62, max(1, math.ceil(math.log2(total + 1)) + SLACK_BITS))
    shared = rows.select(
        "row", "doc_id", "text_sha256", "h", "sender",
        F.shiftrightunsigned("h", 64 - bits).alias("print"),
    ).join(marked.select("sender", "print"), ["sender", "print"], "left_semi")
    local = rows.join(prints.where("n > 1").select("sender", "h"), ["sender", "h"], "left_semi")
    columns = ["row", "doc_id", "text_sha256", "h"]
    doubtful = settle(shared.select(*columns).unionByName(local.select(*columns)).distinct(),
                      "exact-doubtful")

    # byte verification: only these texts move, and equal ones are merged before the shuffle
    texts = narrow.select("doc_id", "normal", F.xxhash64("normal").alias("h"))
    wanted = doubtful.where("row >= 0").select(F.col("doc_id").alias("d_id"), F.col("h").alias("d_h"))
    verified = (
        texts.join(wanted, (texts["h"] == wanted["d_h"]) & texts["doc_id"].eqNullSafe(wanted["d_id"]),
                   "left_semi")
        .groupBy("normal").agg(F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select(F.sha2("normal", 256).alias("text_sha256"), "group_size")
    )
    with filtered_joins(docs.sparkSession):
        verified = settle(verified, "exact-verified")
    keepers = doubtful.groupBy("text_sha256").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")).alias("keep"))
    groups = verified.join(keepers, "text_sha256").select(
        "text_sha256", "group_size", F.col("keep.doc_id").alias("keeper"),
        F.col("keep.row").alias("keep_row"))
    alone = F.col("keep_row").isNull()
    return rows.join(groups, "text_sha256", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keeper")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256", "text_key",
    )


def one_of_each(docs: DataFrame, judged: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose (``doc_id``, ``text_key``) is in ``judged`` with ``kept`` set, all
    columns kept; of rows that share both, one."""
    keys = judged.groupBy("doc_id", "text_key").agg(
        F.count("*").alias("n"), F.max("kept").alias("kept")).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n", "kept")
    rows = packed(docs, id_col, text_col).withColumn("_key", text_key(F.col("_text")))
    # at scale there are never few of them, so no plan is made for a broadcast
    dropped = keys.where("not kept").hint("merge")
    twice = keys.where("kept and n > 1")
    stay = rows.join(dropped, same(rows, dropped, "_id", "_key"), "left_anti")
    single = stay.join(twice, same(stay, twice, "_id", "_key"), "left_anti")
    repeated = stay.join(twice, same(stay, twice, "_id", "_key"), "left_semi").groupBy(
        "_id", "_key").agg(F.min_by("row", F.col("row").cast("string")).alias("row"))
    return single.select("row.*").unionByName(repeated.select("row.*"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that ``exact_duplicates`` keeps, with all their columns."""
    judged = settle(_judged(docs, id_col, text_col), "exact-judged")
    return one_of_each(docs, judged, id_col, text_col)
