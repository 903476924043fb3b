"""Completion of the last word of many queries at once."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import MAX_SUGGESTIONS
from ..functions.text import complete, extract_lexemes
from .names import match_names, match_prefixes
from .ranked import top_n_per_group


def _order() -> list[Column]:
    return [F.desc("priority"), F.col("length"), F.col("suggestion")]


def split_queries(queries: DataFrame, max_lexemes: int | None = None) -> DataFrame:
    """(query_id, prefix, lexeme): words typed so far and the one to complete; queries without
    any word drop out."""
    words = queries.select("query_id", extract_lexemes(F.col("text"), max_lexemes).alias("_w"))
    return words.filter(F.size("_w") > 0).select(
        "query_id", F.slice("_w", F.lit(1), F.size("_w") - 1).alias("prefix"),
        F.element_at("_w", -1).alias("lexeme"),
    )


def technology_candidates(asked: DataFrame, technologies: DataFrame, limit: int,
                          escape: bool) -> DataFrame:
    """(lexeme, language, suggestion, synonym, length): rows any query can need.

    Rows of one language that are all synonyms, or all not, share their priority in every query.
    So a row behind ``limit`` others of its language and kind is never shown, and the shared
    candidates per word can be cut before they meet the queries.
    """
    lexemes = asked.select("lexeme").distinct()
    rows = match_prefixes(lexemes, technologies, "lexeme", "technology", escape).select(
        "lexeme", "language", F.lower("technology").alias("suggestion"), "synonym",
        F.length("technology").alias("length"),
    ).distinct()
    return top_n_per_group(rows, ["lexeme", "language", "synonym"],
                           [F.col("length"), F.col("suggestion")], limit, "_n").drop("_n")


def technology_suggestions(asked: DataFrame, technologies: DataFrame, languages: DataFrame,
                           limit: int, escape: bool) -> DataFrame:
    """(query_id, suggestion, priority, length): 3 for a technology of a language typed before,
    2 for another, 0 for a synonym."""
    typed = asked.select("query_id", F.explode(F.array_distinct("prefix")).alias("_word"))
    typed_languages = match_names(typed, languages, "_word", "language", escape).select(
        "query_id", "language", F.lit(1).alias("_typed")).distinct()
    rows = asked.select("query_id", "lexeme").join(
        technology_candidates(asked, technologies, limit, escape), "lexeme")
    return rows.join(typed_languages, ["query_id", "language"], "left").select(
        "query_id", "suggestion",
        ((2 + F.coalesce("_typed", F.lit(0))) * F.when(F.col("synonym"), 0).otherwise(1))
        .alias("priority"),
        "length",
    ).distinct()


def name_suggestions(asked: DataFrame, names: DataFrame, column: str, priority: int, limit: int,
                     escape: bool) -> DataFrame:
    """(query_id, suggestion, priority, length) from a plain list of names."""
    lexemes = asked.select("lexeme").distinct()
    rows = match_prefixes(lexemes, names.select(column).distinct(), "lexeme", column, escape).select(
        "lexeme", F.lower(column).alias("suggestion"), F.length(column).alias("length")).distinct()
    best = top_n_per_group(rows, ["lexeme"], [F.col("length"), F.col("suggestion")], limit, "_n")
    return asked.select("query_id", "lexeme").join(best.drop("_n"), "lexeme").select(
        "query_id", "suggestion", F.lit(priority).alias("priority"), "length")


def suggestions(asked: DataFrame, technologies: DataFrame, languages: DataFrame, cities: DataFrame,
                countries: DataFrame, limit: int = MAX_SUGGESTIONS,
                escape: bool = False) -> DataFrame:
    """(query_id, pos, suggestion): the best completions, without words typed before.

    Each branch keeps its best ``limit``, then all together; typed words are removed from what is
    left, so there may be fewer than ``limit``.
    """
    branches = [
        technology_suggestions(asked, technologies, languages, limit, escape),
        name_suggestions(asked, languages, "language", 2, limit, escape),
        name_suggestions(asked, cities, "city", 1, limit, escape),
        name_suggestions(asked, countries, "country", 1, limit, escape),
    ]
    best = [top_n_per_group(b, ["query_id"], _order(), limit, "_n").drop("_n") for b in branches]
    together = best[0]
    for branch in best[1:]:
        together = together.unionByName(branch)
    top = top_n_per_group(together, ["query_id"], _order(), limit, "pos")
    return (
        top.join(asked.select("query_id", "prefix"), "query_id")
        .filter(~F.array_contains("prefix", F.col("suggestion")))
        .select("query_id", "pos", complete(F.col("prefix"), F.col("suggestion")).alias("suggestion"))
    )
