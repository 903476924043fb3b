"""Byte-level BPE encoding and decoding with a transducer lexicon of frequent words.

The words of all documents are counted by Spark. The most frequent ones are encoded once and compiled
into a minimal acyclic transducer (``lexicon``); its file is sent to the executors with ``addFile`` and
memory-mapped there. Words that it does not hold are merged exactly, by merge rank.
"""

import hashlib
import heapq
import json
from array import array
from itertools import islice

import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skilltide.storage import new_path

from .files import write
from .frequent import most_frequent
from .kept import kept
from .lexicon import Lexicon, build
from .rows import mapped
from .ship import ship

LEXICON_WORDS = 1 << 15
CACHE_WORDS = 1 << 19
LONG_WORD = 64  # words of more bytes are merged with a heap and not remembered
# white space is spelled out, since engines differ on \s
SPACE = r"\t-\r\x20\x85\xA0  -     　"


SPLIT = regex.compile(
    rf" ?\p{{L}}++|'(?:[stmd]|re|ve|ll)| ?\p{{N}}++| ?[^{SPACE}\p{{L}}\p{{N}}]++"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
SHIFT = 24  # a pair of ids as one number
NONE = 1 << 30  # rank of a pair that cannot be joined


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = [chr(b) if b in plain else "" for b in range(256)]
    for n, b in enumerate(b for b in range(256) if not out[b]):
        out[b] = chr(256 + n)
    return out


class Vocabulary:
    """Ids, merge ranks and special tokens of a byte-level BPE file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        ids = {t: i for t, i in model["vocab"].items()}
        self.byte_ids = [ids[c] for c in letters]
        self.ranks, self.joined = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[ids[left] << SHIFT | ids[right]] = rank
            self.joined.append(ids[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(back[c] for c in t) for t, i in ids.items()}
        self.bytes.update((i, t.encode()) for t, i in self.special.items())
        self.specials = regex.compile("|".join(
            regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Join neighbours by rank, lowest and leftmost first, until no pair can be joined."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        rank, joined = self.ranks.get, self.joined
        ranks = [rank(a << SHIFT | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            ids[i] = new = joined[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << SHIFT | new, NONE)
            if i < len(ranks):
                ranks[i] = rank(new << SHIFT | ids[i + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n steps, over a linked list."""
        rank, n = self.ranks.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = [a << SHIFT | b for a, b in zip(ids, ids[1:])]
        heap = [(rank(p), i) for i, p in enumerate(pairs) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] is None or rank(ids[i] << SHIFT | ids[j]) != best:
                continue  # one of the two has been joined with another
            ids[i], ids[j] = self.joined[best], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (ids[a] << SHIFT | ids[b]) in self.ranks:
                    heapq.heappush(heap, (rank(ids[a] << SHIFT | ids[b]), a))
        return [i for i in ids if i is not None]


class _Words(dict):
    """Words seen by a worker, with their ids as 32-bit numbers; a missing one is looked up in the
    lexicon, else merged."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon

    def __missing__(self, word: str) -> bytes:
        raw = word.encode("utf-8", "replace")
        found = self.lexicon.get(raw) if self.lexicon else None
        ids = array("I", self.vocabulary.merge(raw) if found is None else found).tobytes()
        if len(raw) <= LONG_WORD:
            if len(self) >= CACHE_WORDS:  # those that came first go; frequent ones soon come back
                for old in list(islice(self, CACHE_WORDS // 4)):
                    del self[old]
            self[word] = ids
        return ids


class Coder:
    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.vocabulary, self.words = vocabulary, _Words(vocabulary, lexicon)

    def encode(self, text: str) -> array:
        """Ids of a whole text; strings of special tokens become their ids."""
        out, at = array("I"), 0
        specials = self.vocabulary.specials
        for m in specials.finditer(text) if specials else ():
            self._plain(text[at:m.start()], out)
            out.append(self.vocabulary.special[m.group()])
            at = m.end()
        self._plain(text[at:] if at else text, out)
        return out

    def _plain(self, text: str, out: array) -> None:
        words = self.words
        out.frombytes(b"".join([words[w] for w in SPLIT.findall(text)]))

    def decode(self, ids) -> str:
        """The text of a list of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids)).decode("utf-8", "replace")


def frequent_words(docs: DataFrame, text_col: str, n: int) -> list[str]:
    """The most frequent runs of letters in all texts, at most ``n``."""
    runs = F.explode(F.split(F.col(text_col), "[^\\p{L}]+")).alias("word")
    counted = docs.select(runs).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    return sorted(most_frequent(counted, n))


def send_lexicon(spark: SparkSession, words: list[str], vocabulary: Vocabulary) -> str:
    """Compile the words, with and without a space before them, and give the file to all executors."""
    entries = {}
    for word in words:
        for form in (word, " " + word):
            raw = form.encode("utf-8", "replace")
            entries[raw] = vocabulary.merge(raw)
    address = new_path(spark, "lexicon") + ".bin"
    write(address, build(entries))
    spark.sparkContext.addFile(address)
    return address.rpartition("/")[2]


def _worker_coder(name: str, content: str) -> Coder:
    """The coder of a lexicon, with the words it has seen; a worker holds one."""
    return kept(("coder", name), lambda: Coder(Vocabulary(content), Lexicon(SparkFiles.get(name))))


def encoded(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
            lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """``doc_id, ids, decoded``: the token ids of every whole text, and the text they decode to.

    Null counts as empty; an empty text has no ids. Repeated rows are encoded alike and ids may be
    null. Other columns are ignored; an empty table gives an empty result.
    """
    return _coded(docs, vocabulary_path, id_col, text_col, lexicon_words, "ids array<int>, decoded string",
                  lambda ids, text: (ids, text))


def digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
            lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the rows of ``encoded``."""
    return _coded(
        docs, vocabulary_path, id_col, text_col, lexicon_words,
        "n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda ids, text: (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
                           hashlib.sha256(text.encode()).hexdigest()))


def _coded(docs: DataFrame, vocabulary_path: str, id_col: str, text_col: str, lexicon_words: int,
           schema: str, make) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary_path, encoding="utf-8") as f:
        content = f.read()
    vocabulary = Vocabulary(content)
    name = send_lexicon(spark, frequent_words(docs, text_col, lexicon_words), vocabulary)
    shared = spark.sparkContext.broadcast(content)

    def code(texts: list[str | None]) -> list[tuple]:
        coder = _worker_coder(name, shared.value)
        coded = [coder.encode(text or "") for text in texts]
        return [make(ids, coder.decode(ids)) for ids in coded]

    return mapped(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), code, schema)
