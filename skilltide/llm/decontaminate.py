"""Benchmark decontamination by winnowing, with built-in functions only.

A text's fingerprints are the minimal hashes of K-grams in every window of WINDOW - K + 1 successive
K-grams. Two texts that share a run of WINDOW words share a window of hashes, so they share its
minimum: no shared run of that length is missed.

1. All documents: distinct minima, joined with the minima of the items. What matches names the
   candidate documents and, per candidate, the matching hashes.
2. Candidates only: the places of those hashes, each with K words of context on both sides, joined
   with the places of the items and extended word by word. A run of WINDOW or more words that
   are equal in both is a hit.

Items of fewer than WINDOW words are one window; they are compared as whole n-grams of their own
lengths, which costs nothing when there are none.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skilltide.storage import settle

from .rows import filtered_joins, packed, same, text_key

WINDOW = 10
K = 5
SPREAD = WINDOW - K  # words that may stand before or after a fingerprint within one window
CONTEXT = K + 2 * SPREAD
# words are runs of other characters than these
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text; only A-Z are lower-cased. Null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, BREAKS), "")


def _steps(first: int, last: Column, make) -> Column:
    """[make(i) for i in first..last], empty when last < first."""
    return F.when(last >= first, F.transform(F.sequence(F.lit(first), last), make)).otherwise(
        F.transform(F.array().cast("array<int>"), make))


def _grams(hashed: Column) -> Column:
    return _steps(0, F.size(hashed) - K, lambda i: F.xxhash64(*[F.get(hashed, i + d) for d in range(K)]))


def _minima(grams: Column) -> Column:
    return F.array_distinct(_steps(
        0, F.size(grams) - SPREAD - 1,
        lambda i: F.least(*[F.get(grams, i + d) for d in range(SPREAD + 1)])))


def with_grams(df: DataFrame) -> DataFrame:
    """Add ``grams``, the hashes of all K-grams of ``words``."""
    hashed = df.withColumn("hashed", F.transform("words", lambda w: F.xxhash64(w)))
    return hashed.withColumn("grams", _grams(F.col("hashed"))).drop("hashed")


def _places(df: DataFrame, wanted: str, *keys: str) -> DataFrame:
    """(keys, h, at, around): every place of a wanted hash, with its words and their neighbours."""
    at = F.filter(_steps(0, F.size("grams") - 1, lambda i: i),
                  lambda i: F.array_contains(F.col(wanted), F.get(F.col("grams"), i)))
    around = F.transform(at, lambda i: F.struct(
        F.get(F.col("grams"), i).alias("h"), i.alias("at"),
        F.array(*[F.get(F.col("words"), i + d) for d in range(-SPREAD, K + SPREAD)]).alias("around")))
    return df.select(*keys, F.explode(around).alias("p")).select(*keys, "p.*")


def _extent(equal: Column) -> tuple[Column, Column]:
    """Words before and after the fingerprint that belong to the equal run."""
    wrong = F.filter(F.sequence(F.lit(0), F.lit(CONTEXT - 1)), lambda i: ~F.get(equal, i))
    before = F.array_max(F.filter(wrong, lambda i: i < SPREAD))
    after = F.array_min(F.filter(wrong, lambda i: i >= SPREAD + K))
    return (SPREAD - 1 - F.coalesce(before, F.lit(-1)),
            F.coalesce(after, F.lit(CONTEXT)) - SPREAD - K)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word of a document is hit when it lies in an occurrence of a window of some item. Null and
    empty texts have no words and no hits; items without words have no windows; repeated items
    count by their id. Rows that share id and text get equal results; rows that share only the id
    are judged apart. Items with a null id hit words but are not counted or listed. Other columns
    are ignored; an empty table on either side gives no hits.
    """
    return _judged(docs, items, id_col, text_col, item_col, item_text_col).drop("text_key")


def _judged(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str,
            item_text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"),
                        text_key(F.col(text_col)).alias("text_key"))
    keyed = texts.select("doc_id", "text_key", words(F.col("_text")).alias("words"))
    bench = items.select(F.col(item_col).alias("item_id"),
                         words(F.col(item_text_col)).alias("words")).where(F.size("words") > 0)
    key = ["doc_id", "text_key"]

    grams = with_grams(keyed)
    long_items = with_grams(bench.where(F.size("words") >= WINDOW)).withColumn(
        "minima", _minima(F.col("grams")))
    item_places = settle(_places(long_items, "minima", "item_id").select(
        "item_id", "h", F.col("around").alias("item_words")).distinct(), "bench-places")
    found = settle(
        grams.select(*key, F.explode(_minima(F.col("grams"))).alias("h"))
        .join(item_places.select("h").distinct(), "h")
        .groupBy(*key).agg(F.collect_set("h").alias("wanted")), "bench-candidates")

    # the texts of candidates only move: Spark filters the others out before the shuffle
    found = found.where(F.size("wanted") > 0).withColumnsRenamed({"doc_id": "f_id", "text_key": "f_key"})
    candidates = with_grams(texts.join(
        found, (texts["text_key"] == found["f_key"]) & texts["doc_id"].eqNullSafe(found["f_id"])).select(
        *key, words(F.col("_text")).alias("words"), "wanted"))
    hits = _places(candidates, "wanted", *key).join(item_places, "h").select(
        *key, "item_id", "at", F.zip_with(
            "around", "item_words", lambda a, b: F.coalesce(a == b, F.lit(False))).alias("equal"))
    before, after = _extent(F.col("equal"))
    centre = F.forall(F.slice("equal", SPREAD + 1, K), lambda e: e)
    runs = hits.select(*key, "item_id", "at", before.alias("before"), after.alias("after"),
                       centre.alias("centre")).where(
        F.col("centre") & (F.col("before") + F.col("after") + K >= WINDOW))
    runs = runs.select(*key, "item_id", (F.col("at") - F.col("before")).alias("start"),
                       (F.col("at") + K - 1 + F.col("after")).alias("end"))

    short = bench.where(F.size("words") < WINDOW)
    for n in sorted(r[0] for r in short.select(F.size("words")).distinct().collect()):
        whole = short.where(F.size("words") == n).select(
            "item_id", F.array_join("words", " ").alias("whole"))
        spans = keyed.select(*key, F.posexplode(_steps(
            0, F.size("words") - n,
            lambda i: F.concat_ws(" ", *[F.get(F.col("words"), i + d) for d in range(n)]),
        )).alias("start", "whole"))
        runs = runs.unionByName(spans.join(whole, "whole").select(
            *key, "item_id", "start", (F.col("start") + n - 1).alias("end")))

    covered = F.array_distinct(F.flatten(F.transform(
        "spans", lambda s: F.sequence(s["start"], s["end"]))))
    with filtered_joins(docs.sparkSession):
        per_doc = settle(runs.groupBy(*key).agg(
            F.collect_set(F.struct("start", "end")).alias("spans"),
            F.collect_set(F.col("item_id").cast("string")).alias("items")).select(
            F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key"),
            F.size(covered).cast("long").alias("n_hit"), F.array_sort("items").alias("items")),
            "bench-hits")
    counted = keyed.select(*key, F.size("words").cast("long").alias("n_words"))
    listed = F.coalesce(F.array_join("items", ","), F.lit(""))
    return counted.join(per_doc, counted["doc_id"].eqNullSafe(per_doc["h_id"])
                        & (counted["text_key"] == per_doc["h_key"]), "left").select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The documents that share no window with an item, with all their columns."""
    found = _judged(docs, items, id_col, text_col, "item_id", "text").where("contaminated").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct().hint(
        "merge")  # at scale they are never few
    rows = packed(docs, id_col, text_col).withColumn("_key", text_key(F.col("_text")))
    return rows.join(found, same(rows, found, "_id", "_key"), "left_anti").select("row.*")
