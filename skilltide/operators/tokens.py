"""Classes of the words of a query."""

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed import TOKEN_TYPES
from ..functions.text import extract_lexemes, is_stop_word
from .names import match_names


def query_lexemes(queries: DataFrame, max_lexemes: int | None = None) -> DataFrame:
    """(query_id, pos, lexeme) from (query_id, text), positions from 0."""
    return queries.select(
        "query_id", F.posexplode(extract_lexemes(F.col("text"), max_lexemes)).alias("pos", "lexeme")
    )


def stop_words(lexemes: DataFrame) -> DataFrame:
    """Stop words, once per occurrence."""
    return lexemes.filter(is_stop_word(F.col("lexeme"))).select(
        "query_id", F.lit("stopWord").alias("token_type"), F.lower("lexeme").alias("lexeme")
    )


def named_tokens(lexemes: DataFrame, names: DataFrame, escape: bool = False) -> DataFrame:
    """Stored names (token_type, name) that a word of the query matches; once per stored name."""
    words = lexemes.select("query_id", "lexeme").distinct()
    hits = match_names(words, names.distinct(), escape=escape).drop("lexeme").distinct()
    return hits.select("query_id", "token_type", F.lower("name").alias("lexeme"))


def unknown_lexemes(lexemes: DataFrame, names: DataFrame) -> DataFrame:
    """Words that are neither stop words nor stored names, with their position and repeats.

    A word that equals a stored name always matches it, so the difference is one anti join.
    """
    known = names.select(F.lower("name").alias("lexeme")).distinct()
    return lexemes.filter(~is_stop_word(F.col("lexeme"))).join(known, "lexeme", "left_anti").select(
        "query_id", "pos", "lexeme"
    )


def unknown_text(queries: DataFrame, unknown: DataFrame) -> DataFrame:
    """(query_id, text): the unknown words of each query in order, '' without any.

    A query is one text of the input, so the list is no longer than that text.
    """
    joined = unknown.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "lexeme"))),
                        lambda x: x.getField("lexeme")), " ",
        ).alias("text")
    )
    return queries.select("query_id").join(joined, "query_id", "left").select(
        "query_id", F.coalesce("text", F.lit("")).alias("text")
    )


def token_map(queries: DataFrame, tokens: DataFrame) -> DataFrame:
    """(query_id, tokens): all six classes as a map, empty lists where nothing was found."""
    types = F.array(*[F.lit(t) for t in TOKEN_TYPES])
    frame = queries.select("query_id", F.explode(types).alias("token_type"))
    lists = tokens.groupBy("query_id", "token_type").agg(
        F.array_sort(F.collect_list("lexeme")).alias("lexemes")
    )
    filled = frame.join(lists, ["query_id", "token_type"], "left").withColumn(
        "lexemes", F.coalesce("lexemes", F.array().cast("array<string>"))
    )
    return filled.groupBy("query_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("token_type", "lexemes"))))
        .alias("tokens")
    )
