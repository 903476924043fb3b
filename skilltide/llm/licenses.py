"""Licence scan: texts against licence templates by the Dice coefficient of word bigrams.

Compared are the lines, the paragraphs and the whole of every text, lower-cased, without punctuation
and, for more than a line, without copyright lines. Two sets of a and b bigrams can reach a coefficient
t only if a * t / (2 - t) <= b <= a * (2 - t) / t; these bounds drop units that fit no template and prune
the templates of the rest. A unit then has at least b * t / (2 - t) of a template's b bigrams, and so has the
text it is part of: whole texts with fewer go first. Common bigrams are counted by equality joins with
the bigrams of the templates, which are a fixed list.

What is left of a text between the units that match is compared by runs of consecutive lines too, so a
notice needs no blank lines around it.
"""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skilltide.storage import settle

from .license_texts import TEMPLATES
from .rows import filtered_joins, same, text_key

THRESHOLD = 0.85
COPYRIGHT_LINES = "(?idm)^[ \\t]*(copyright|\\(c\\)|©)[^\\n]*"
NO_WORD = "[^\\p{L}\\p{N}]+"
TAKEN = "\x01"  # stands for a matched unit
BLANK_LINE = "\\n[ \\t\\r]*\\n"


def _bigrams(text: Column) -> Column:
    """Hashes of the distinct word bigrams; none for fewer than two words."""
    words = F.array_remove(F.split(F.lower(text), NO_WORD), "")
    return F.array_distinct(F.zip_with(
        words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))),
        lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))))


def _template_grams(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(template, license, t_size, gram)"""
    table = spark.createDataFrame(
        [(i, name, text) for i, (name, text) in enumerate(templates)],
        "template int, license string, template_text string")
    table = table.withColumn("grams", F.array_compact(_bigrams(F.col("template_text"))))
    return table.select("template", "license", F.size("grams").alias("t_size"),
                        F.explode("grams").alias("gram"))


def _possible(docs: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, text_key, template) of the texts that have enough of a template's bigrams for a unit in
    them to reach the threshold, wherever it begins and ends. ``docs`` are (doc_id, text_key, text)."""
    whole = F.coalesce("text", F.lit(""))
    free = F.regexp_replace(whole, COPYRIGHT_LINES, "")
    # paragraphs have bigrams of their own where a copyright line went
    grams = F.array_compact(F.when(free == whole, _bigrams(whole)).otherwise(
        F.array_union(_bigrams(whole), _bigrams(free))))
    least = F.col("t_size") * (threshold / (2 - threshold))
    held = docs.select("doc_id", "text_key", grams.alias("grams")).select(
        "doc_id", "text_key", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    # the sum over rows that share id and text is no less than over one of them
    return (held.join(F.broadcast(table), "gram").where(F.col("size") >= least)
            .groupBy("doc_id", "text_key", "template", "t_size").agg(F.count("*").alias("common"))
            .where(F.col("common") >= least).select("doc_id", "text_key", "template"))


def _units(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    free = F.regexp_replace(whole, COPYRIGHT_LINES, "")
    return F.array_distinct(F.concat(
        F.split(whole, "\\n"), F.split(free, BLANK_LINE), F.array(free)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe join of tables that may come from the same one."""
    other = right.select(*[F.col(k).alias("_" + k) if k in keys else F.col(k) for k in right.columns])
    equal = [F.col(k).eqNullSafe(F.col("_" + k)) for k in keys]
    return left.join(other, reduce(and_, equal), how).drop(*["_" + k for k in keys])


def _rests(left: DataFrame, matched: DataFrame) -> DataFrame:
    """(doc_id, text_key, rest, text): the whole lines between the units that match, per text.
    ``matched`` are (doc_id, text_key, unit_text)."""
    taken = matched.groupBy("doc_id", "text_key").agg(F.collect_list("unit_text").alias("taken"))
    plain = F.translate(F.coalesce("text", F.lit("")), TAKEN, " ")
    units = F.sort_array(F.transform(F.coalesce("taken", F.array().cast("array<string>")), lambda u: F.struct(
        F.length(u).alias("n"), F.translate(u, TAKEN, " ").alias("text"))), asc=False)
    line = F.concat(F.lit("\n"), F.regexp_replace(plain, COPYRIGHT_LINES, ""), F.lit("\n"))
    mark = F.lit(f"\n{TAKEN}\n")

    def without(text: Column, unit: Column) -> Column:
        own = F.concat(F.lit("\n"), unit["text"], F.lit("\n"))
        return F.replace(F.replace(text, own, mark), own, mark)  # neighbours share a line break

    rests = F.split(F.aggregate(units, line, without), TAKEN)
    return _joined(left, taken, ["doc_id", "text_key"], "left").select(
        "doc_id", "text_key", F.posexplode(rests).alias("rest", "text"))


def _windows(rests: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, text_key, unit, license, dice): runs of lines that reach the threshold. Of runs that
    overlap, the one with the highest product of coefficient and common bigrams stays.

    A run begins and ends at a line with a bigram of the template. Lines are taken from the last to the first, with
    the next occurrence of every bigram from there on, nearest first; those of the line move to the front.
    No run has more than ``high`` times the bigrams of its template, so the list is cut there and the work
    grows with the lines, however often a notice is repeated.
    """
    key = ["doc_id", "text_key", "rest"]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.array_remove(
        F.split(F.lower(x), NO_WORD), "")), lambda w: F.size(w) > 0)
    words = F.flatten(F.transform(lines, lambda ws, i: F.transform(
        ws, lambda w: F.struct(i.alias("line"), w.alias("word")))))
    pairs = F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.when(
        b.isNotNull(), F.struct(F.xxhash64(a["word"], b["word"]).alias("gram"), a["line"].alias("lo"),
                                b["line"].alias("hi"))))
    places = rests.select(*key, words.alias("words")).select(
        *key, F.posexplode(F.array_compact(pairs)).alias("pos", "pair")).select(*key, "pos", "pair.*")
    before = F.lag("lo", 1, -1).over(Window.partitionBy(*key, "gram").orderBy("pos"))
    places = settle(places.withColumn("prev", before).where("prev < lo").drop("pos"), "license-places")
    least = F.col("t_size") * low
    fits = (places.where("prev < 0").join(F.broadcast(table), "gram")
            .groupBy(*key, "template", "license", "t_size").agg(F.count("*").alias("common"))
            .where(F.col("common") >= least).drop("common"))
    hits = F.broadcast(table.select("template", "gram", F.lit(True).alias("hit")))
    place = F.struct("gram", "hi", F.coalesce("hit", F.lit(False)).alias("hit"))
    per_line = (
        _joined(places, fits, key).join(hits, ["template", "gram"], "left")
        .groupBy(*key, "template", "license", "t_size", "lo").agg(F.collect_list(place).alias("places")))
    rows = per_line.groupBy(*key, "template", "license", "t_size").agg(
        F.sort_array(F.collect_list(F.struct("lo", "places")), asc=False).alias("lines"))

    def ended(acc: Column) -> Column:
        """The best run so far, with the one that ends at the line of ``acc``."""
        dice = 2 * acc["common"] / (acc["size"] + F.col("t_size"))
        return _let(dice, lambda d: F.when(
            (d >= threshold) & (d * acc["common"] > acc["best"]["score"]),
            F.struct((d * acc["common"]).alias("score"), d.alias("dice"), acc["hi"].alias("end"))
        ).otherwise(acc["best"]))

    none = F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("dice"), F.lit(-1).alias("end"))

    def best_run(ahead: Column) -> Column:
        start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("common"), F.lit(-1).alias("hi"), none.alias("best"))
        return F.aggregate(ahead, start, lambda acc, x: F.struct(
            (acc["size"] + 1).alias("size"), (acc["common"] + x["hit"].cast("int")).alias("common"),
            x["hi"].alias("hi"), F.when(x["hi"] == acc["hi"], acc["best"]).otherwise(ended(acc)).alias("best")), ended)

    reach = F.floor(F.col("t_size") * high).cast("int") + 1

    def moved(ahead: Column, line: Column) -> Column:
        grams = F.transform(line["places"], lambda x: x["gram"])
        return F.slice(F.concat(
            F.filter(line["places"], lambda x: x["hi"] == line["lo"]),
            F.filter(line["places"], lambda x: x["hi"] > line["lo"]),
            _let(grams, lambda own: F.filter(ahead, lambda x: ~F.array_contains(own, x["gram"])))), F.lit(1), reach)

    def step(acc: Column, line: Column) -> Column:
        def found(ahead: Column) -> Column:
            enough = F.exists(line["places"], lambda x: x["hit"]) & (
                F.size(F.filter(ahead, lambda x: x["hit"])) >= least)
            run = F.when(enough, best_run(ahead)).otherwise(none)
            return F.struct(ahead.alias("ahead"), _let(run, lambda r: F.when(
                r["end"] >= 0, F.array_append(acc["runs"], F.struct(line["lo"].alias("start"), r.alias("best")))
            ).otherwise(acc["runs"])).alias("runs"))
        return _let(moved(acc["ahead"], line), found)

    nothing = F.struct(
        F.array().cast("array<struct<gram:bigint,hi:int,hit:boolean>>").alias("ahead"),
        F.array().cast("array<struct<start:int,best:struct<score:double,dice:double,end:int>>>").alias("runs"))
    start = F.col("start")
    runs = rows.select(*key, "template", "license", F.explode(
        F.aggregate("lines", nothing, step, lambda acc: acc["runs"])).alias("run")).select(
        *key, "template", "license", "run.*")
    listed = F.sort_array(F.collect_list(F.struct(
        "best.score", "best.dice", (-F.col("template")).alias("order"), (-start).alias("back"), "start",
        F.col("best.end").alias("end"), "license")), asc=False)
    apart = F.aggregate(
        F.slice("runs", 2, F.size("runs")), F.slice("runs", 1, 1),
        lambda kept, r: F.when(F.exists(kept, lambda k: (k["start"] <= r["end"]) & (r["start"] <= k["end"])),
                               kept).otherwise(F.array_append(kept, r)))
    return runs.groupBy(*key).agg(listed.alias("runs")).select(
        *key, F.posexplode(apart).alias("at", "run")).select(
        "doc_id", "text_key", (-1 - F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy(
            "rest", "at"))).alias("unit"), "run.license", "run.dice")


def license_matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES,
                    id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, unit, license, dice): the best template of every unit that reaches the
    threshold; of equal coefficients, the first template. A text's repeated units count once. Runs of
    lines between those units have negative numbers."""
    table = _template_grams(docs.sparkSession, templates)
    sizes = table.agg(F.min("t_size"), F.max("t_size")).first()
    key = ["doc_id", "text_key"]
    texts = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"),
                        F.col(text_col).alias("text"))
    pairs = settle(_possible(texts, table, threshold), "license-pairs")
    some = pairs.select(*key).distinct()
    with filtered_joins(docs.sparkSession):
        # few texts are left; those that share id and text are one
        left = settle(texts.join(some, same(texts, some, *key), "left_semi").dropDuplicates(key),
                      "license-texts")
    units = left.select(*key, F.posexplode(_units(F.col("text"))).alias("unit", "unit_text"))
    sized = units.select(*key, "unit", F.array_compact(_bigrams(F.col("unit_text"))).alias("grams"))
    sized = sized.withColumn("size", F.size("grams"))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    possible = sized.where((F.col("size") >= (sizes[0] or 0) * low)
                           & (F.col("size") <= (sizes[1] or 0) * high))
    common = (
        possible.select(*key, "unit", "size", F.explode("grams").alias("gram"))
        .join(F.broadcast(table), "gram")  # a fixed list of some thousand bigrams
        .where((F.col("size") >= F.col("t_size") * low) & (F.col("size") <= F.col("t_size") * high))
        .groupBy(*key, "unit", "size", "template", "license", "t_size")
        .agg(F.count("*").alias("common"))
    )
    dice = 2 * F.col("common") / (F.col("size") + F.col("t_size"))
    best = F.max_by(F.struct("license", "dice"), F.struct("dice", -F.col("template")))
    found = settle(common.withColumn("dice", dice).where(F.col("dice") >= threshold)
                   .groupBy(*key, "unit").agg(best.alias("best")).select(*key, "unit", "best.*"),
                   "license-units")
    matched = _joined(units, found, [*key, "unit"], "left_semi").select(*key, "unit_text")
    return found.unionByName(_windows(_rests(left, matched), table, threshold))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES,
                 id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, n_matches, licenses, best_dice``.

    ``licenses`` lists the licences found, sorted and comma-joined; empty, with 0 matches and a null
    coefficient, when there is none, as for null and empty texts. Rows that share id and text
    are judged alike, rows that share only the id apart. Other columns are ignored; an empty table
    gives an empty result.
    """
    found = license_matches(docs, templates, id_col, text_col, threshold).groupBy(
        "doc_id", "text_key").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("license")).alias("names"),
        F.max("dice").alias("best_dice"))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"))
    return rows.join(found, same(rows, found, "doc_id", "text_key"), "left").select(
        rows["doc_id"], F.coalesce("n", F.lit(0).cast("long")).alias("n_matches"),
        F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"), "best_dice")
