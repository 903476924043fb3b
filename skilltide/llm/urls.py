"""URL filter: rules first, else naive Bayes on segmented host names and path tokens.

Word counts come from the visible text of all pages, and all of them are the unigram model. They stay a table:
the substrings of the distinct parts of host names look up their counts by an equality join, and Viterbi
splits every part with just those words. Multinomial naive Bayes is trained on the pages that a rule
decides, over hashed tokens, so its tables have a fixed size.
"""

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skilltide.storage import settle

from .ship import ship

# fixed values: (verdict, rule)
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/")]
LONGEST = 24  # letters of a word of the unigram model
BUCKETS = 1 << 16
SMOOTHING = 1.0
SPLIT = re.compile(r"[^\w]+|_")
NUMBER = re.compile(r"\d+")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end; A-Z lower-cased. Empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host, up to ``? #`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does. Of rules of one length,
    the first in the list."""
    fitting = []
    for says, text in sorted(rules, key=lambda r: -len(r[1])):  # stable: the first of equals stays first
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        fitting.append((fits, text, says))
    none = F.lit(None).cast("string")
    return (F.coalesce(*[F.when(f, F.lit(text)) for f, text, _ in fitting], none),
            F.coalesce(*[F.when(f, F.lit(says)) for f, _, says in fitting], none))


def word_counts(pages: DataFrame, html_col: str) -> DataFrame:
    """(word, n) over the visible text of all pages."""
    visible = F.regexp_replace(F.lower(F.col(html_col)), "(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    return pages.select(F.explode(F.split(visible, "[^\\p{L}]+")).alias("word")).where(
        "word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def pieces_of(host: str) -> list[str]:
    """The parts of a host name that are to be split into words."""
    return [piece for part in SPLIT.split(host) for piece in NUMBER.sub("0", part).split("0") if piece]


def path_tokens(path: str) -> list[str]:
    """Words of the path, marked as such; digits are one token."""
    return ["p:" + NUMBER.sub("0", t) for t in SPLIT.split(path) if t]


class Segmenter:
    """Unigram Viterbi over a word -> log probability table. ``total`` is that of the whole model, where
    ``counts`` are only the words that can occur."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = total or sum(counts.values()) or 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.unknown = -math.log(1 / (10 * total))

    def _price(self, word: str) -> float:
        """Unseen words cost more by the letter, so that known ones are preferred."""
        return self.cost.get(word) or self.unknown + 4.0 * (len(word) - 1)

    def split(self, name: str) -> tuple[str, ...]:
        """The cheapest split; of equally cheap ones, that with the longest last word."""
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            price, start = min((best[i] + self._price(name[i:end]), i)
                               for i in range(max(0, end - LONGEST), end))
            best.append(price)
            back.append(start)
        out, end = [], len(name)
        while end:
            out.append(name[back[end]:end])
            end = back[end]
        return tuple(reversed(out))

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of the host parts, marked as such, and of the path; digits are one token."""
        return ["h:" + w for piece in pieces_of(host) for w in self.split(piece)] + path_tokens(path)


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words) of the distinct hosts that have any; ``counts`` are (word, n) of the whole model."""
    total = counts.agg(F.sum("n")).first()[0]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(h, i, p) for h in pdf["host"] for i, p in enumerate(pieces_of(h))],
                               columns=["host", "at", "piece"])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"piece": pdf["piece"], "words": [
                list(Segmenter({} if w is None else dict(zip(w, n)), total).split(p))
                for p, w, n in zip(pdf["piece"], pdf["known"], pdf["counts"])]})

    parts = settle(hosts.select("host").distinct().mapInPandas(cut, "host string, at int, piece string"),
                   "host-parts")
    labels = parts.select("piece").distinct()
    size, piece = F.length("piece"), F.col("piece")
    strings = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(LONGEST), size - i + 1)), lambda k: piece.substr(i, k))))
    known = labels.select("piece", F.explode(F.array_distinct(strings)).alias("word")).join(
        counts, "word").groupBy("piece").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    splits = labels.join(known, "piece", "left").select(
        "piece", F.col("known.word").alias("known"), F.col("known.n").alias("counts")).mapInPandas(
        split, "piece string, words array<string>")
    listed = F.array_sort(F.collect_list(F.struct("at", "words")))
    return settle(parts.join(splits, "piece").groupBy("host").agg(
        F.flatten(listed["words"]).alias("words")), "host-words")


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id",
               url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, block_score``.

    A rule fits its domain and all subdomains when the path starts with the rule's; the longest wins.
    ``block_score`` is the method's log odds for every page; above 0 it blocks. Pages without a
    rule get its verdict. Null URLs and URLs without ``://`` have an empty host and path, no tokens,
    and the verdict of the class shares. Where only one class was seen it is the verdict, and
    with none everything is allowed. Repeated rows are judged alike; other columns are ignored.
    """
    spark = pages.sparkSession
    ship(spark)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                         path_of(F.col(url_col)).alias("path"))
    words = host_words(parts, settle(word_counts(pages, html_col), "word-counts"))
    ruled = parts.withColumn("rule", rule).withColumn("ruled", verdict).join(words, "host", "left")

    def tokens(words: Iterable[str] | None, path: str) -> list[str]:
        return ["h:" + w for w in (() if words is None else words)] + path_tokens(path)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros((2, BUCKETS), np.int64)
        rows = [0, 0]
        for pdf in batches:
            for words, path, says in zip(pdf["words"], pdf["path"], pdf["ruled"]):
                kind = int(says == "block")
                rows[kind] += 1
                for t in tokens(words, path):
                    found[kind, _bucket(t)] += 1
        kinds, at = np.nonzero(found)
        yield pd.DataFrame({"kind": [*kinds, 0, 1], "bucket": [*at, -1, -1],
                            "n": [*found[kinds, at], *rows]})

    # at most 2 * BUCKETS rows come back, whatever the number of pages
    table = ruled.where("ruled is not null").select("words", "path", "ruled").mapInPandas(
        count, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(
        F.sum("n").alias("n")).toPandas()
    seen = np.zeros(2)
    counted = np.zeros((2, BUCKETS))
    for kind, bucket, n in zip(table["kind"], table["bucket"], table["n"]):
        if bucket < 0:
            seen[kind] = n
        else:
            counted[kind, bucket] = n
    if seen.min() == 0:
        prior, odds = float(seen[1] - seen[0]), np.zeros(BUCKETS)
    else:
        prior = math.log(seen[1] / seen[0])
        # unseen buckets are neutral: smoothing uses the buckets that occur
        present = np.count_nonzero(counted.sum(axis=0))
        logs = np.log(counted + SMOOTHING) - np.log(
            counted.sum(axis=1, keepdims=True) + SMOOTHING * present)
        odds = np.where(counted.sum(axis=0) > 0, logs[1] - logs[0], 0.0)
    model = spark.sparkContext.broadcast((prior, odds))

    @F.pandas_udf("double")
    def block_score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        prior, odds = model.value
        for hosts, paths in batches:
            yield pd.Series([prior + sum(float(odds[_bucket(t)]) for t in tokens(h, p))
                             for h, p in zip(hosts, paths)])

    judged = ruled.withColumn("block_score", block_score("words", "path"))
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("block_score") > 0, "block").otherwise("allow")).alias("verdict"),
        "block_score")
