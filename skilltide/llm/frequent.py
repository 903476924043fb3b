"""The most frequent words, without a sorted list of candidates from every task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skilltide.storage import settle


def most_frequent(counted: DataFrame, limit: int) -> dict[str, int]:
    """Word -> n of the rows of ``counted`` (word, n) with at least n0 occurrences, where n0 is the
    smallest number, 2 or more, that at most ``limit`` words reach. Words that occur once never count
    as frequent. What comes to the driver is one row per distinct count up to the limit, then those
    words.
    """
    table = settle(counted.where("n > 1"), "word-counts")
    # distinct counts above the cut are at most ``limit``, since each of them has a word
    sizes = table.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(limit + 1)
    cut, words = None, 0
    for row in sizes.collect():
        words += row["words"]
        if words > limit:
            break
        cut = row["n"]
    if cut is None:
        return {}
    return {r["word"]: r["n"] for r in table.where(F.col("n") >= cut).collect()}
