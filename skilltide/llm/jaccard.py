"""N-gram Jaccard join by MinHash banding.

1. Texts with equal sets of word shingles form a class; one representative of each goes on.
2. ``bands`` x ``rows`` minima per set. The number of bands is the smallest at which a pair of the
   threshold's similarity shares a band with at least the target recall.
3. Shuffle on band hashes. Single buckets are dropped; those with the same smallest member, which a group of
   near copies mostly has in common, are merged into one bucket that this member names.
4. Pairs are verified on the full shingle sets, which are sent once for each bucket. A bucket of more than BLOCK
   members is cut into blocks, one task entry for each pair of blocks; what leaves it is one row per
   member (its number of links, and the smallest member it hangs on), never the pairs. A pair that meets
   in several buckets counts in the smallest of them.
5. Components of the verified links.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skilltide.storage import settle

from .components import components
from .exact import one_of_each
from .kept import forget
from .rows import filtered_joins, text_key
from .ship import ship

SHINGLE = 5
THRESHOLD = 0.8
ROWS = 5
RECALL = 0.99999
BLOCK = 4096  # members of a group compared with as many others in one task
BLOCK_SHINGLES = 1 << 19  # that those hold, about
CHUNK = 1 << 17  # shingles hashed at a time
WORD_BREAKS = "[^\\p{L}\\p{N}]+"


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """Bands at which a pair of just this similarity is found with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words (runs of letters and digits) of a text, in order."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAKS)
    return F.transform(F.array_remove(parts, ""), lambda w: F.xxhash64(w))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; a shorter text is one shingle."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    size = min(size, len(hashes))
    h = hashes.astype(np.uint64)
    mixed = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        mixed = (mixed ^ h[i:len(h) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _sets(lists: pd.Series, size: int) -> list[np.ndarray]:
    return [shingles(np.asarray(x, dtype=np.int64), size) for x in lists]


def _signer(size: int, bands: int, rows: int):
    generator = np.random.default_rng(20)
    a = (generator.integers(1, 1 << 32, bands * rows, dtype=np.uint64) | 1).astype(np.uint32)
    b = generator.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
    weights = generator.integers(1, 1 << 62, rows, dtype=np.uint64) | np.uint64(1)

    def minima(sets: list[np.ndarray]) -> np.ndarray:
        """One row of minima for each set; sets are hashed together up to CHUNK shingles."""
        flat = np.concatenate(sets)
        x = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
        out = np.empty((len(sets), bands * rows), np.uint32)
        scratch = np.empty_like(x)
        for j in range(bands * rows):
            np.multiply(x, a[j], out=scratch)
            scratch += b[j]
            # low bits of a product are weak; the order is taken after a shift back in
            scratch ^= scratch >> np.uint32(15)
            out[:, j] = np.minimum.reduceat(scratch, starts)
        return out

    def keys(minimal: np.ndarray) -> np.ndarray:
        parts = minimal.reshape(len(minimal), bands, rows).astype(np.uint64) + np.uint64(1)
        mixed = np.zeros((len(minimal), bands), np.uint64)
        for i in range(rows):
            mixed = (mixed ^ parts[:, :, i]) * weights[i]
            mixed ^= mixed >> np.uint64(31)
        mixed += np.arange(bands, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        return (mixed * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        forget()
        for pdf in batches:
            sets = _sets(pdf["hashes"], size)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            signed: list = [[]] * len(sets)
            todo = [i for i, s in enumerate(sets) if len(s)]
            while todo:
                n = take = 0
                while take < len(todo) and (take == 0 or n + len(sets[todo[take]]) <= CHUNK):
                    n += len(sets[todo[take]])
                    take += 1
                for i, row in zip(todo[:take], keys(minima([sets[i] for i in todo[:take]]))):
                    signed[i] = row
                todo = todo[take:]
            yield pd.DataFrame({"row": pdf["row"], "doc_id": pdf["doc_id"],
                                "text_key": pdf["text_key"], "digest": digests,
                                "n": [len(s) for s in sets], "bands": signed})
    return sign


def _linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix: Jaccard similarity of full sets at or above the threshold."""
    sizes_l = np.array([len(s) for s in left])
    sizes_r = np.array([len(s) for s in right])
    flat = np.concatenate(right)
    owner = np.repeat(np.arange(len(right)), sizes_r)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = np.zeros((len(left), len(right)), bool)
    own = left is right
    if own:  # equal hashes stand by owner, so behind an entry are those of later sets only
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        place = np.split(place, np.cumsum(sizes_r)[:-1])
        ends = np.searchsorted(flat, flat, "right")
    for i, s in enumerate(left):
        if own:
            lo, hi = place[i] + 1, ends[place[i]]
        else:
            lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        lengths = hi - lo
        total = int(lengths.sum())
        if total:
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(total)
            common = np.bincount(owner[at], minlength=len(right))
            # integer form of common / union >= threshold, exact for thresholds like 0.8
            union = sizes_l[i] + sizes_r - common
            out[i] = common * 1_000_000 >= union * round(threshold * 1_000_000)
    if own:
        out |= out.T
        np.fill_diagonal(out, sizes_l > 0)
    return out


def _verifier(threshold: float):
    def judge(rows: list) -> Iterator[tuple]:
        """rows: (member, weight, block, hashes of the set, buckets, parts, bucket) of one pair of blocks."""
        # rows that share id and text both come with the set of their class
        rows = list({r[0]: r for r in rows}.values())
        part_a, part_b, bucket = rows[0][5:]
        left = [r for r in rows if r[2] == part_a]
        right = left if part_a == part_b else [r for r in rows if r[2] == part_b]
        if not left or not right:
            return
        sets = [r[3] for r in left]
        linked = _linked(sets, sets if left is right else [r[3] for r in right], threshold)
        first = 0 if left is right else len(left)  # where the right ones stand among all
        rows = left if left is right else left + right
        members = np.array([r[0] for r in rows], np.int64)
        weights = np.array([r[1] for r in rows], np.int64)
        links, root = np.zeros_like(members), members.copy()
        elsewhere: dict[int, list[int]] = {}  # right ones by the smaller buckets that they are in as well
        for j, r in enumerate(right):
            for b in r[4]:
                if b < bucket:
                    elsewhere.setdefault(b, []).append(j)
        elsewhere = {b: np.array(x) for b, x in elsewhere.items()}
        for i, (one, row) in enumerate(zip(left, linked)):  # the pairs of a whole block would be many times its members
            if left is right:
                row[:i + 1] = False
            two = first + np.flatnonzero(row)
            if not len(two):
                continue
            joined = np.unique(np.append(root[two], root[i]))
            for x in joined[1:]:
                root[root == x] = joined[0]
            for b in one[4]:
                if b in elsewhere:
                    row[elsewhere[b]] = False  # the pair counts there
            two = first + np.flatnonzero(row)
            links[i] += weights[two].sum()
            links[two] += weights[i]
        for member, n, x in zip(members.tolist(), links.tolist(), root.tolist()):
            if n or x != member:
                yield member, n, x

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        key = None
        out: list = []
        names = ["member", "links", "root"]
        for pdf in batches:
            for member, weight, block, part_a, part_b, head, hashes, buckets in zip(
                    pdf["member"], pdf["weight"], pdf["block"], pdf["part_a"], pdf["part_b"],
                    pdf["head"], pdf["shingles"], pdf["buckets"]):
                now = (head, part_a, part_b)
                if now != key:
                    out.extend(judge(held) if held else ())
                    held, key = [], now
                held.append((member, weight, block, np.asarray(hashes), buckets, part_a, part_b, head))
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        out.extend(judge(held) if held else ())
        yield pd.DataFrame(out, columns=names)
    return verify


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD, size: int = SHINGLE, rows: int = ROWS,
                  recall: float = RECALL) -> DataFrame:
    """One row per document: ``doc_id, text_key, row, class_id, n_links, kept``.

    Two documents are linked when the Jaccard similarity of their sets of ``size``-word shingles
    is at least ``threshold``; words are lower-cased runs of letters and digits. ``n_links`` counts
    the other documents linked with this one, copies included. ``class_id`` is the smallest id of its
    connected group; one row of each group, the one with that id, is ``kept``. A text of fewer
    words is one shingle. Null texts and texts without words have no shingles, are linked with
    nothing and form groups of their own. Null ids come last and do not connect rows; repeated rows
    are linked like copies. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    bands = bands_for(threshold, rows, recall)
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("doc_id"),
        text_key(F.col(text_col)).alias("text_key"), word_hashes(F.col(text_col)).alias("hashes"))
    # ids pass pandas as texts, which would make rounded floats of longs with a null among them
    signed = settle(source.mapInPandas(
        _signer(size, bands, rows),
        "row long, doc_id string, text_key long, digest binary, n int, bands array<long>").withColumn(
        "doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType)), "signatures")

    # classes of equal sets; the representative is the row with the smallest id
    full = signed.where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row",
                           "text_key", "n", "bands"))
    reps = settle(full.groupBy("digest").agg(F.count("*").alias("weight"), first.alias("r")).select(
        "digest", "weight", F.col("r.row").alias("member"), "r.doc_id", "r.text_key", "r.n", "r.bands"),
        "representatives")

    exploded = reps.select("member", F.explode("bands").alias("band"))
    buckets = settle(exploded.groupBy("band").agg(
        F.count("*").alias("m"), F.min("member").alias("bucket")).where("m > 1"), "buckets").where("m > 1")
    with filtered_joins(spark):
        own = exploded.join(buckets, "band").groupBy("member").agg(F.collect_set("bucket").alias("buckets"))
        wanted = settle(reps.join(own, "member").select(
            "member", "weight", "n", "buckets", F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key")),
            "members")
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("held") / BLOCK_SHINGLES)).cast("int")
    # few: at most bands times all shingles / BLOCK_SHINGLES, and as many times all members / BLOCK
    cut = wanted.select("n", F.explode("buckets").alias("head")).groupBy("head").agg(
        F.count("*").alias("m"), F.sum("n").alias("held")).select("head", blocks.alias("blocks")).where("blocks > 1")

    # full sets of the members, from their texts
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"),
                        text_key(F.col(text_col)).alias("text_key"))
    wanted = wanted.where("weight > 0")
    texts = texts.join(wanted, (texts["text_key"] == wanted["w_key"])
                       & texts["doc_id"].eqNullSafe(wanted["w_id"])).select(
        "member", "weight", "buckets", word_hashes(F.col("_text")).alias("hashes")
    )

    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["shingles"] = [s.astype(np.int64) for s in _sets(pdf["hashes"], size)]
            yield pdf[["member", "weight", "buckets", "shingles"]]

    sets = texts.mapInPandas(
        to_sets, "member long, weight long, buckets array<long>, shingles array<long>")
    placed = sets.withColumn("head", F.explode("buckets")).join(F.broadcast(cut), "head", "left").withColumn(
        "blocks", F.coalesce("blocks", F.lit(1))).withColumn(
        "block", F.pmod(F.xxhash64("member", F.lit(2)), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "member", "weight", "buckets", "shingles", "head", "block", F.least("block", "other").alias("part_a"),
        F.greatest("block", "other").alias("part_b"))
    tasks = spread.repartition("head", "part_a", "part_b").sortWithinPartitions("head", "part_a", "part_b")
    with filtered_joins(spark):
        found = settle(tasks.mapInPandas(_verifier(threshold), "member long, links long, root long"),
                       "verified")
    links = found.groupBy("member").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("member").alias("u"), F.col("root").alias("v")))

    # back to documents; the smallest id names the group
    named = reps.join(links, "member", "left").join(
        groups.withColumnRenamed("node", "member"), "member", "left").select(
        "digest", "weight", "member", "doc_id", F.coalesce("root", "member").alias("root"),
        F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    heads = named.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("missing"), "doc_id", "member")).alias("head"))
    classes = named.join(heads, "root").select(
        "digest", F.col("head.doc_id").alias("class_id"), F.col("head.member").alias("head"),
        (F.col("links") + F.col("weight") - 1).alias("n_links"))
    result = signed.select("row", "doc_id", "text_key", "digest", "n").join(
        classes, "digest", "left")
    empty = F.col("n") == 0
    return result.select(
        "doc_id", "text_key", "row",
        F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(empty, F.lit(0).cast("long")).otherwise(F.col("n_links")).alias("n_links"),
        (empty | (F.col("row") == F.col("head"))).alias("kept"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each connected group of ``jaccard_links``, with all its columns."""
    judged = settle(jaccard_links(docs, id_col, text_col), "links-judged")
    return one_of_each(docs, judged, id_col, text_col)
