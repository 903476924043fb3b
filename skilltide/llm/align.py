"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of linked token pairs.

Both tokenizers cut the same bytes into tokens. Tokens of the two that overlap are linked, and places
where both end a token cut the text into groups. Each place where either ends a token stands for one
link, so links and groups come from one sorted list of ends, without comparing tokens. Texts are cut
before spaces and line feeds, where both tokenizers always end a token; a segment that a worker has seen
is not aligned again.

The first pass aligns every document and stores, a few rows per task, the distinct pairs and in how many
of the task's documents each is linked. The distinct pairs of all tasks get a minimal perfect hash
(``perfecthash``), in shards. Each group of ``FAN`` tasks scatters its counts into a dense vector per
shard by that hash, and the vectors are added up in a tree, ``FAN`` at a time. The second pass aligns
every document again and looks its pairs up in the memory-mapped shards, whose stored keys are compared.
"""

import hashlib
import json
import mmap
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skilltide.storage import new_path, settle

from .bpe import SPACE, Vocabulary
from .files import write
from .perfecthash import PerfectHash, build, mixed
from .ship import ship

# fixed value: the pattern that splits a text into words before byte-level merges
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARDS = 16
FAN = 16  # tasks, then vectors, that are added up at a time
CHUNK_CHARACTERS = 1 << 20  # texts aligned at a time, unless one alone is longer
HELD_SEGMENTS = 1 << 19  # that a worker remembers
HELD_PAIRS = 1 << 20  # distinct pairs that a task gathers before it hands them on
OTHER = SPACE.replace(r"\t-\r\x20", r"\t\x0B-\r")  # white space but the space and the line feed
SEGMENT = re.compile(f"[{SPACE}]*[^{SPACE}]+(?:[{OTHER}][{SPACE}]*[^{SPACE}]*)*|[{SPACE}]+")
BLANKS = re.compile(r"\s{2048}")  # the faster library can't split runs of very many


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, byte_vocabulary: str, piece_model: bytes):
        import sentencepiece
        import tiktoken
        self.content, self._library = byte_vocabulary, None
        own = Vocabulary(byte_vocabulary)
        self.a_bytes = [own.bytes.get(i, b"") for i in range(max(own.bytes) + 1)]
        self.words = None
        if own.joined == sorted(own.joined):  # ids in the order of the merges serve as ranks
            ranks = {t: i for i, t in own.bytes.items() if i not in own.special.values()}
            self.words = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks,
                                           special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.b_bytes = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.a_sizes = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)
        self.width = len(self.b_bytes)
        # a piece that goes on into a space or line feed would span a cut
        across = regex.compile(rf"[^{SPACE}][ \n]| \n")
        self.splits = not any(across.search(t.decode("utf-8", "replace")) for t in self.b_bytes)
        self.blank = self.pieces.piece_to_id("▁")
        # every token as it appears in a list of groups: A inside, A last, B inside, B last
        self.letters = [f"{i}{end}" for n, ends in ((len(self.a_bytes), ",|"), (self.width, ",;"))
                        for end in ends for i in range(n)]

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def segments(self, text: str) -> list[str]:
        """A space and the text, cut where a space or line feed follows anything but white space.

        No token of either tokenizer goes across such a place, and neither looks across it, so each
        segment has the same tokens alone as in the text.
        """
        return SEGMENT.findall(" " + text) if self.splits else [" " + text]

    def first(self, text: str) -> list[int]:
        if self.words and not (len(text) > 2048 and BLANKS.search(text)):
            return self.words.encode_ordinary(text)
        if self._library is None:
            from tokenizers import Tokenizer
            spec = json.loads(self.content) | {"truncation": None, "padding": None}
            self._library = Tokenizer.from_str(json.dumps(spec))
            self._library.encode_special_tokens = True
        return self._library.encode(text, add_special_tokens=False).ids

    def second(self, text: str) -> list[int]:
        """The model puts a space before what it encodes: that of the text, else one too many."""
        if text[0] == " ":
            return self.pieces.encode(text[1:]) if len(text) > 1 else [self.blank]
        ids = self.pieces.encode(text)
        return ids[1:] if ids[:1] == [self.blank] else []

    def tokens(self, segments: list[str]) -> tuple[list[int], list[int], list[bool]]:
        """Ids of A and of B, segment after segment, and whether both give the segment back; one that
        fails has no ids. Segments that end in white space must come alone."""
        text = "".join(segments)
        raw, a, b = text.encode(), self.first(text), self.second(text)
        if b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b)):
            return a, b, [True] * len(segments)
        if len(segments) == 1:
            return [], [], [False]
        half = len(segments) // 2
        return tuple(x + y for x, y in zip(self.tokens(segments[:half]), self.tokens(segments[half:])))


@dataclass
class Aligned:
    """Segments one after the other; what belongs to the i-th lies between borders i and i + 1."""
    good: np.ndarray  # whether both tokenizers give the segment back; one that fails has no tokens
    a: np.ndarray
    b: np.ndarray
    a_border: np.ndarray
    b_border: np.ndarray
    pairs: np.ndarray  # of each link, A id * width + B id
    border: np.ndarray  # of links
    groups: np.ndarray  # how many
    a_group: np.ndarray  # of each token, counted over all segments
    b_group: np.ndarray


def _border(lengths) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.fromiter(lengths, np.int64))]).astype(np.int64)


def distinct(numbers: np.ndarray) -> np.ndarray:
    """In ascending order."""
    ordered = np.sort(numbers)
    return ordered[np.append(True, ordered[1:] != ordered[:-1])] if len(ordered) else ordered


def align(tokenizers: Tokenizers, segments: list[str]) -> Aligned:
    """Segments end where tokens of both end, so all are aligned as if they were one text."""
    open_end = next((i for i, s in enumerate(segments) if s[-1].isspace()), len(segments))
    parts = [segments[:open_end]] if open_end else []
    parts += [[s] for s in segments[open_end:]]
    found = [tokenizers.tokens(part) for part in parts]
    a, b, good = (list(chain.from_iterable(x)) for x in zip(*found)) if found else ([], [], [])
    a, b, good = np.array(a, np.int64), np.array(b, np.int64), np.array(good, bool)
    a_end, b_end = np.cumsum(tokenizers.a_sizes[a]), np.cumsum(tokenizers.b_sizes[b])
    last = _border(len(s.encode()) if g else 0 for s, g in zip(segments, good))
    ends = np.sort(np.concatenate([a_end, b_end]))
    twice = np.append(ends[1:] == ends[:-1], False) if len(ends) else np.zeros(0, bool)
    common, ends = ends[twice], ends[~twice]
    pairs = a[np.searchsorted(a_end, ends)] * tokenizers.width + b[np.searchsorted(b_end, ends)]
    a_border, b_border, border = (np.searchsorted(x, last, side="right") for x in (a_end, b_end, ends))
    return Aligned(good, a, b, a_border, b_border, pairs, border,
                   np.diff(np.searchsorted(common, last, side="right")),
                   np.searchsorted(common, a_end), np.searchsorted(common, b_end))


def group_texts(tokenizers: Tokenizers, x: Aligned) -> Iterator[str]:
    """``a1,a2|b1;a3|b2,b3;`` of each segment: the ids of A and of B, group by group."""
    n_a = len(tokenizers.a_bytes)
    shown = np.zeros(len(x.a) + len(x.b), np.int64)
    for ids, group, other, start, size, late in (
            (x.a, x.a_group, x.b_group, 0, n_a, "left"),
            (x.b, x.b_group, x.a_group, 2 * n_a, tokenizers.width, "right")):
        if len(ids):
            closing = np.append(group[1:] != group[:-1], True)
            # behind its own kind's earlier tokens, and the other's of earlier groups (B: of its own too)
            place = np.arange(len(ids)) + np.searchsorted(other, group, side=late)
            shown[place] = ids + start + size * closing
    border = (x.a_border + x.b_border).tolist()
    letters = [tokenizers.letters[i] for i in shown.tolist()]
    for start, end in pairwise(border):
        yield "".join(letters[start:end])


def chunks(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts, null as empty, in runs of at most CHUNK_CHARACTERS or of one text."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text or "") > CHUNK_CHARACTERS:
            yield held
            held, size = [], 0
        held.append(text or "")
        size += len(text or "")
    if held:
        yield held


class Segments:
    """Aligned segments, remembered while they recur.

    ``numbers`` has a row of a segment: whether it fails, tokens of A, tokens of B, groups, links, and with a
    lexicon the links that are the best of their A id and the sum of all links' counts.
    """

    def __init__(self, tokenizers: Tokenizers, lexicon: "Lexicon | None" = None):
        self.tokenizers, self.lexicon = tokenizers, lexicon
        self.index: dict[str, int] = {}
        self.numbers = np.zeros((0, 7), np.int64)
        self.pairs, self.border = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.groups: list[str] = []
        self.used = np.zeros(0, np.int64)
        self.characters = 0

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the segments of all texts, and the borders of the texts."""
        if len(self.index) > HELD_SEGMENTS or self.characters > 16 * HELD_SEGMENTS:
            self._forget()
        found = [self.tokenizers.segments(t) if t else [] for t in texts]
        fresh = set(chain.from_iterable(found)).difference(self.index)
        if fresh:
            self._add(sorted(fresh, key=lambda s: s[-1].isspace()))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(found)), np.int64)
        self.used += np.bincount(at, minlength=len(self.used))
        return at, _border(map(len, found))

    def _add(self, fresh: list[str]) -> None:
        x = align(self.tokenizers, fresh)
        numbers = np.zeros((len(fresh), 7), np.int64)
        numbers[:, 0] = ~x.good
        for i, border in ((1, x.a_border), (2, x.b_border), (4, x.border)):
            numbers[:, i] = np.diff(border)
        numbers[:, 3] = x.groups
        if self.lexicon:
            count = self.lexicon.counts(x.pairs)
            best = count == self.lexicon.best[x.pairs // self.tokenizers.width]
            for i, values in ((5, best), (6, count)):
                numbers[:, i] = np.diff(np.concatenate([[0], np.cumsum(values)])[x.border])
            self.groups += group_texts(self.tokenizers, x)
        self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh))))
        self.numbers = np.concatenate([self.numbers, numbers])
        self.border = np.concatenate([self.border, x.border[1:] + self.border[-1]])
        self.pairs = np.concatenate([self.pairs, x.pairs])
        self.used = np.concatenate([self.used, np.zeros(len(fresh), np.int64)])
        self.characters += sum(map(len, fresh))

    def _forget(self) -> None:
        """Keep the segments that came most often, at most a half."""
        least = max(2, int(np.partition(self.used, -(len(self.used) // 2) - 1)[-(len(self.used) // 2) - 1]) + 1)
        names = [s for s, i in self.index.items() if self.used[i] >= least and len(s) < 256]
        old = np.array([self.index[s] for s in names], np.int64)
        self.index = {s: i for i, s in enumerate(names)}
        self.pairs, sizes = self.links(old), np.diff(self.border)[old]
        self.border, self.numbers = _border(sizes), self.numbers[old]
        self.groups = [self.groups[i] for i in old.tolist()] if self.lexicon else []
        self.used, self.characters = np.zeros(len(names), np.int64), sum(map(len, names))

    def links(self, at: np.ndarray) -> np.ndarray:
        """Pairs of all links of these segments, in order."""
        sizes = np.diff(self.border)[at]
        start = np.repeat(self.border[at] - (np.cumsum(sizes) - sizes), sizes)
        return self.pairs[start + np.arange(len(start))]

    def fails(self, at: np.ndarray, border: np.ndarray) -> np.ndarray:
        """Texts with a segment that fails."""
        return np.diff(np.concatenate([[0], np.cumsum(self.numbers[at, 0])])[border]) > 0


class _Counts:
    """Documents by pair, as sorted arrays that are merged when they have grown."""

    def __init__(self):
        self.keys, self.counts, self.fresh = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def add(self, held: Segments, texts: list[str]) -> None:
        at, border = held.of(texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(border))
        good = ~held.fails(at, border)[doc]
        n = max(len(held.index), 1)
        doc, at = np.divmod(distinct(doc[good] * n + at[good]), n)
        pairs = held.links(at)
        order = int(pairs.max(initial=0)) + 1
        doc = np.repeat(doc, np.diff(held.border)[at])
        self.fresh.append(distinct(doc * order + pairs) % order)
        if sum(map(len, self.fresh)) > max(HELD_PAIRS, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *self.fresh])
        weights = np.concatenate([self.counts, np.ones(len(keys) - len(self.keys), np.int64)])
        order = np.argsort(keys, kind="stable")
        self.keys = distinct(keys)
        self.counts = np.add.reduceat(weights[order], np.searchsorted(keys[order], self.keys)) if len(
            keys) else weights
        self.fresh = []


def shard_of(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 0) % np.uint64(SHARDS)).astype(np.int64)


@lru_cache(maxsize=1)
def _tokenizers(byte_vocabulary: str, piece_model: bytes) -> Tokenizers:
    return Tokenizers(byte_vocabulary, piece_model)


_latest: list = [None, None]


def _segments(contents: tuple[str, bytes], lexicon: "Lexicon | None") -> Segments:
    """The segments that this worker remembers, for one lexicon at a time."""
    key = contents, lexicon and lexicon.stem
    if _latest[0] != key:
        _latest[:] = key, Segments(_tokenizers(*contents), lexicon)
    return _latest[1]


def _local_counts(docs: DataFrame, contents) -> DataFrame:
    """(task, shard, keys, counts): the pairs of a task's documents, a few rows per task."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, task = _segments(contents.value, None), TaskContext.get().partitionId()

        def emit(held: _Counts) -> pa.RecordBatch:
            held.merge()
            shard = shard_of(held.keys)
            split = [np.flatnonzero(shard == s) for s in range(SHARDS)]
            offsets = pa.array(_border(map(len, split)).astype(np.int32))
            order = np.concatenate(split)
            return pa.RecordBatch.from_arrays(
                [pa.array([task] * SHARDS, pa.int64()), pa.array(range(SHARDS), pa.int32()),
                 pa.ListArray.from_arrays(offsets, pa.array(held.keys[order])),
                 pa.ListArray.from_arrays(offsets, pa.array(held.counts[order]))],
                ["task", "shard", "keys", "counts"])

        held = _Counts()
        for batch in batches:
            for texts in chunks(batch.column("_text").to_pylist()):
                held.add(segments, texts)
                if len(held.keys) > HELD_PAIRS:
                    yield emit(held)
                    held = _Counts()
        if len(held.keys) or held.fresh:
            yield emit(held)

    return docs.select("_text").mapInArrow(
        gather, "task long, shard int, keys array<long>, counts array<long>")


def _hashed(local: DataFrame, folder: str) -> list[int]:
    """Write the perfect hash of every shard that has pairs; the shards."""
    def make(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        write(f"{folder}/{os.path.basename(folder)}-{key[0]}.hash", build(pdf["key"].to_numpy()))
        return pd.DataFrame({"shard": [key[0]], "n": [len(pdf)]})

    # distinct pairs are at most (ids of A) x (ids of B) / SHARDS in a group, whatever the documents
    pairs = local.select("shard", F.explode("keys").alias("key")).distinct()
    made = pairs.groupBy("shard").applyInPandas(make, "shard int, n long").collect()
    return sorted(r["shard"] for r in made)


def _mapped(name: str) -> np.ndarray:
    """A file that every executor has, memory-mapped: its workers share it."""
    with open(SparkFiles.get(name), "rb") as f:
        return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.int64)


@lru_cache(maxsize=2 * SHARDS)
def _hash(stem: str, shard: int) -> PerfectHash:
    return PerfectHash(_mapped(f"{stem}-{shard}.hash"))


@lru_cache(maxsize=2 * SHARDS)
def _vector(stem: str, shard: int) -> np.ndarray:
    return _mapped(f"{stem}-{shard}.counts")


def _summed(local: DataFrame, stem: str) -> DataFrame:
    """(shard, vector) after adding up the dense vectors of all tasks in a tree."""
    def scatter(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        table = _hash(stem, key[0])
        total = np.zeros(table.n, np.int64)
        for keys, counts in zip(pdf["keys"], pdf["counts"]):
            total[table.numbers(np.asarray(keys, np.int64))] += np.asarray(counts, np.int64)
        return pd.DataFrame({"shard": [key[0]], "node": [key[1]], "vector": [total.tobytes()]})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, np.int64) for v in pdf["vector"])
        return pd.DataFrame({"shard": [key[0]], "node": [key[1]], "vector": [total.tobytes()]})

    schema = "shard int, node long, vector binary"
    parent = F.floor(F.col("node") / FAN).alias("node")
    held = local.where(F.size("keys") > 0)
    vectors = held.select("shard", F.floor(F.col("task") / FAN).alias("node"), "keys", "counts").groupBy(
        "shard", "node").applyInPandas(scatter, schema)
    tasks = local.agg(F.max("task")).first()[0] or 0
    nodes = tasks // FAN
    while nodes:
        vectors = vectors.select("shard", parent, "vector").groupBy("shard", "node").applyInPandas(add, schema)
        nodes //= FAN
    return vectors


def _send(spark: SparkSession, folder: str, shards: list[int], kind: str) -> None:
    for shard in shards:
        spark.sparkContext.addFile(f"{folder}/{os.path.basename(folder)}-{shard}.{kind}")


@dataclass(eq=False)
class Lexicon:
    """Counts of pairs: the stem of the files' names, their shards, and the highest count of each A id."""
    stem: str
    shards: list[int]
    best: np.ndarray

    def counts(self, pairs: np.ndarray) -> np.ndarray:
        """The count of each pair, 0 for one that no document links."""
        own = distinct(pairs)
        out, shard = np.zeros(len(own), np.int64), shard_of(own)
        for s in self.shards:
            at = np.flatnonzero(shard == s)
            number = _hash(self.stem, s).numbers(own[at])
            known = number >= 0
            out[at[known]] = _vector(self.stem, s)[number[known]]
        return out[np.searchsorted(own, pairs)]


def pair_counts(docs: DataFrame, contents) -> Lexicon:
    """First pass over (_id, _text) rows: in how many documents each pair is linked."""
    spark = docs.sparkSession
    tokenizers = _tokenizers(*contents.value)
    width, n_a = tokenizers.width, len(tokenizers.a_bytes)
    local = settle(_local_counts(docs, contents), "local-pairs")
    folder = new_path(spark, "pairs")
    stem = os.path.basename(folder)
    shards = _hashed(local, folder)
    _send(spark, folder, shards, "hash")

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, vector in zip(pdf["shard"], pdf["vector"]):
                write(f"{folder}/{stem}-{shard}.counts", vector)
                best = np.zeros(n_a, np.int64)
                np.maximum.at(best, _hash(stem, shard).keys // width, np.frombuffer(vector, np.int64))
                at = np.flatnonzero(best)
                yield pd.DataFrame({"a": at, "best": best[at]})

    # one number per id of A, at most
    found = _summed(local, stem).mapInPandas(store, "a long, best long").groupBy("a").agg(
        F.max("best").alias("best")).toPandas()
    _send(spark, folder, shards, "counts")
    best = np.zeros(n_a, np.int64)
    best[found["a"].to_numpy(np.int64)] = found["best"]
    return Lexicon(stem, shards, best)


RESULT = ("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups string, groups_sha256 string")


def alignments(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id",
               text_col: str = "text", with_groups: bool = True) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups,
    groups_sha256``.

    ``groups`` lists the token ids of both tokenizers, group by group (null if ``with_groups`` is
    off, when only its SHA-256 is wanted). A text that is null or empty, or that one of the tokenizers does not
    give back byte for byte, has no tokens: zeros, and '' for both strings. A repeated row is a document of its
    own and counts; ids may be null. Other columns are ignored, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(byte_path, encoding="utf-8") as f, open(piece_path, "rb") as g:
        contents = spark.sparkContext.broadcast((f.read(), g.read()))  # two vocabulary files
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    lexicon = spark.sparkContext.broadcast(pair_counts(texts, contents))
    names = [c.split()[0] for c in RESULT.split(", ")]

    def rows(texts: list[str]) -> list[tuple]:
        held = _segments(contents.value, lexicon.value)
        at, border = held.of(texts)
        sums = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(held.numbers[at, 1:], axis=0)])[border]
        good = ~held.fails(at, border)
        out = []
        for i, row in enumerate((np.diff(sums, axis=0) * good[:, None]).tolist()):
            own = at[border[i]:border[i + 1]].tolist() if good[i] else []
            groups = "".join([held.groups[j] for j in own])[:-1]
            digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
            out.append((*row, groups if with_groups else None, digest))
        return out

    id_type = docs.schema[id_col].dataType.simpleString()
    types = [pa.int64()] * 6 + [pa.string()] * 2

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for texts in chunks(batch.column("_text").to_pylist()):
                columns = list(zip(*rows(texts)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(start, len(texts)),
                     *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", *names])
                start += len(texts)

    return texts.mapInArrow(code, f"doc_id {id_type}, {RESULT}")
