"""Queries in bulk: tokens, ranked pages, suggestions."""

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed import MAX_SUGGESTIONS, SEARCH_PAGE_SIZE
from ..operators import search as s, suggest as sg, tokens as t
from ..operators.locations import resolve_location
from ..storage import settle
from .ranking import verified_technologies, with_documents

Tables = dict[str, DataFrame]


def stored_names(tables: Tables) -> DataFrame:
    """(token_type, name, language) of everything a word can stand for."""
    def rows(table: str, kind: str, column: str, language) -> DataFrame:
        return tables[table].select(
            F.lit(kind).alias("token_type"), F.col(column).alias("name"), language.alias("language"))

    none = F.lit(None).cast("string")
    return (
        rows("languages", "language", "language", none)
        .unionByName(rows("technologies", "technology", "technology", F.col("language")))
        .unionByName(rows("users", "githubLogin", "login", none))
    )


def tokenize(queries: DataFrame, tables: Tables, gazetteer: DataFrame,
             max_lexemes: int | None = None, escape: bool = False) -> DataFrame:
    """(query_id, token_type, lexeme): stop words, stored names, and the place that the remaining
    words name."""
    lexemes = settle(t.query_lexemes(queries, max_lexemes), "lexemes")
    names = stored_names(tables)
    rest = t.unknown_text(queries, t.unknown_lexemes(lexemes, names))
    place = resolve_location(rest, ["query_id"], "text", gazetteer)
    places = place.select("query_id", F.explode(F.array(
        F.struct(F.lit("city").alias("token_type"), F.col("city").alias("lexeme")),
        F.struct(F.lit("country").alias("token_type"), F.col("country").alias("lexeme")),
    )).alias("x")).select("query_id", "x.*").filter("lexeme IS NOT NULL")
    return (
        t.stop_words(lexemes)
        .unionByName(t.named_tokens(lexemes, names, escape))
        .unionByName(places)
    )


def search_tokens(queries: DataFrame, tables: Tables, max_lexemes: int | None = None,
                  escape: bool = False) -> DataFrame:
    """The tokens a search uses: languages, technologies and logins."""
    return t.named_tokens(t.query_lexemes(queries, max_lexemes), stored_names(tables), escape)


def search_index(tables: Tables, ranks: DataFrame, block_ranks: int = s.BLOCK_RANKS) -> s.SearchIndex:
    """Index of the verified technologies and their languages, and of the words of logins, stored for many
    searches. To be made anew with the ranking."""
    return s.build_index(verified_technologies(tables), ranks, block_ranks)


def search(queries: DataFrame, ranks: DataFrame, index: s.SearchIndex, tables: Tables,
           page_size: int = SEARCH_PAGE_SIZE, max_lexemes: int | None = None,
           escape: bool = False) -> DataFrame:
    """(query_id, position, user_id, login_match, rank) for queries (query_id, text, page).

    ``ranks`` of ``rank_users`` and ``index`` of ``search_index`` are made once for many searches.
    """
    tokens = settle(search_tokens(queries, tables, max_lexemes, escape), "tokens")
    return s.search_pages(queries, tokens, ranks, index, page_size)


def search_documents(results: DataFrame, ranks: DataFrame, tables: Tables) -> DataFrame:
    """(query_id, json) for the rows of ``search``; lists are built for shown users only."""
    pages = settle(results, "results")
    shown = ranks.join(pages.select("user_id").distinct(), "user_id", "left_semi")
    documents = with_documents(shown, tables).drop("rank", "avg_grade")
    grades = F.transform("grades", lambda g: F.from_json(g, "category STRING, value DOUBLE"))
    total = F.aggregate("grades", F.lit(0.0), lambda acc, g: acc + g.getField("value"))
    users = documents.withColumn("grades", grades).withColumn(
        "avg_grade", F.try_divide(total, F.size("grades")))
    return s.to_result_json(pages.join(users, "user_id"))


def suggest(queries: DataFrame, tables: Tables, limit: int = MAX_SUGGESTIONS,
            max_lexemes: int | None = None, escape: bool = False) -> DataFrame:
    """(query_id, pos, suggestion) for queries (query_id, text)."""
    asked = sg.split_queries(queries, max_lexemes)
    return sg.suggestions(asked, tables["technologies"], tables["languages"], tables["cities"],
                          tables["countries"], limit, escape)


def suggestion_documents(suggested: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, json) with the list of suggestions, empty where there are none."""
    lists = suggested.groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "suggestion"))),
        lambda x: x.getField("suggestion")).alias("suggestions"))
    empty = F.array().cast("array<string>")
    return queries.select("query_id").join(lists, "query_id", "left").select(
        "query_id",
        F.to_json(F.struct(F.coalesce("suggestions", empty).alias("suggestions"))).alias("json"))
