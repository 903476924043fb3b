"""Ranked search for many queries at once.

A rank names its user and is the sort key, so matches are found, combined and cut by rank alone. The
index has postings (kind, token, rank) in folders by blocks of ranks, the best block first, with the number
of users of each token beside them. Queries that name the same languages and technologies are answered
once. Blocks are opened from the top until every page is full; the rarest technology of a query leads, and
only its users are looked up for the others. A query without names matches everyone, and is answered from
the top of the ranking without listing everyone.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import text_tokens, text_words
from ..storage import settle
from .ranked import top_n_per_group

BLOCK_RANKS = 1 << 20
GROWTH = 8  # times as many blocks are opened when pages are not full
COMMON_LOGINS = 1000  # a word that more logins have is scored once for all sets that share it
REPEATED = 1.64493406685  # fixed value: the sum that weights of repeats approach


class SearchIndex(NamedTuple):
    """postings: kind, token, rank, block. vocabulary: kind, token, users. logins: token, rank, times.
    last: the best rank, None without users. block_ranks: ranks in a block."""

    postings: DataFrame
    vocabulary: DataFrame
    logins: DataFrame
    last: int | None
    block_ranks: int = BLOCK_RANKS


def postings(technologies: DataFrame, ranks: DataFrame) -> DataFrame:
    """(kind, token, rank) from (user_id, language, technology) and the ranking."""
    # with the user among their columns, distinct rows are found where the join has put them
    return (
        technologies.join(ranks.select("user_id", "rank"), "user_id")
        .select("user_id", "rank", F.explode(F.array(
            F.struct(F.lit("language").alias("kind"), F.col("language").alias("text")),
            F.struct(F.lit("technology").alias("kind"), F.col("technology").alias("text")),
        )).alias("x"))
        .select("user_id", "rank", "x.kind", "x.text").distinct()
        .select("user_id", "rank", "kind", F.explode(text_tokens(F.col("text"))).alias("token"))
        .distinct().drop("user_id")
    )


def login_postings(ranks: DataFrame) -> DataFrame:
    """(token, rank, times): the words of each login and how often it has them."""
    words = ranks.select("rank", F.explode(text_words(F.col("login"))).alias("token"))
    return words.groupBy("token", "rank").agg(F.count("*").alias("times"))


def build_index(technologies: DataFrame, ranks: DataFrame, block_ranks: int = BLOCK_RANKS) -> SearchIndex:
    """The stored index of a ranking, for many searches."""
    last = ranks.agg(F.max("rank")).first()[0]
    block = F.floor((F.lit(last or 0) - F.col("rank")) / block_ranks).cast("int").alias("block")
    rows = settle(postings(technologies, ranks).select("*", block), "postings", by="block")
    counts = rows.groupBy("kind", "token").agg(F.count("*").alias("users"))
    return SearchIndex(rows, settle(counts, "vocabulary"), settle(login_postings(ranks), "logins"), last,
                       block_ranks)


def matched_tokens(lexemes: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token_type, lexeme, token, users): index tokens a query token stands for. Languages match whole
    tokens, technologies match prefixes.

    Works on the vocabulary, not on the users.
    """
    wanted = lexemes.select("token_type", "lexeme").distinct()
    known = vocabulary.withColumnRenamed("kind", "token_type")
    languages = known.filter(F.col("token_type") == "language").withColumn("lexeme", F.col("token"))
    prefixes = F.transform(
        F.sequence(F.lit(1), F.length("token")),
        lambda n: F.substring(F.col("token"), F.lit(1), n),
    )
    technologies = known.filter(F.col("token_type") == "technology").withColumn(
        "lexeme", F.explode(prefixes))
    both = languages.unionByName(technologies)
    return both.join(wanted, ["token_type", "lexeme"], "left_semi")


def _named(tokens: DataFrame, *types: str) -> DataFrame:
    """(query_id, names): the distinct tokens of these types, for queries that have any. No list is longer
    than the query."""
    return tokens.filter(F.col("token_type").isin(*types)).groupBy("query_id").agg(
        F.sort_array(F.collect_set(F.struct("token_type", "lexeme"))).alias("names"))


def _sets(queries: DataFrame, names: DataFrame, page_size: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, page, key) of the queries that have names, and (key, names, need) once per distinct set
    of names: how many users the furthest of its pages asks for."""
    keyed = queries.select("query_id", "page").join(names, "query_id").withColumn("key", F.to_json("names"))
    wanted = keyed.groupBy("key").agg(
        F.first("names").alias("names"), F.max(F.col("page") * page_size).cast("int").alias("need"))
    return keyed.select("query_id", "key"), wanted


def _of_set(name: str) -> Column:
    return F.filter("names", lambda x: x["token_type"] == name)


def best_by_names(wanted: DataFrame, index: SearchIndex) -> DataFrame:
    """(key, rank): the best ``need`` users of each set, that have all of its technologies and any of its
    languages.

    Each round opens ``GROWTH`` times as many blocks as the one before, for the sets whose pages are not
    full by then. A user of a further block has a worse rank than all of the nearer ones, so a full
    page is final.
    """
    kinds = wanted.select("*", F.size(_of_set("language")).alias("languages"),
                          F.size(_of_set("technology")).alias("technologies"))
    lexemes = kinds.select("key", "languages", "technologies", F.explode("names").alias("x")).select(
        "key", "languages", "technologies", "x.*")
    matched = settle(matched_tokens(lexemes, index.vocabulary), "matched-tokens")
    users = matched.groupBy("token_type", "lexeme").agg(F.sum("users").alias("users"))
    sized = lexemes.join(users, ["token_type", "lexeme"], "left").withColumn(
        "users", F.coalesce("users", F.lit(0)))
    rarest = sized.filter("token_type = 'technology'").groupBy("key").agg(
        F.min_by("lexeme", F.struct("users", "lexeme")).alias("lexeme")).withColumn(
        "token_type", F.lit("technology"))
    leading = rarest.unionByName(lexemes.filter("technologies = 0").select("key", "lexeme", "token_type"))
    remaining, found, opened = wanted.select("key", "need"), [], 1
    blocks = -(-(index.last or 0) // index.block_ranks)
    if blocks <= 1:
        return _best_in_blocks(remaining, leading, lexemes, matched, index, opened)
    leading = settle(leading, "leading-lexemes")
    while True:
        top = settle(_best_in_blocks(remaining, leading, lexemes, matched, index, opened), "best")
        found.append(top)
        if opened >= blocks:
            break
        full = top.groupBy("key").agg(F.count("*").alias("n"))
        rest = settle(remaining.join(full, "key", "left").filter("coalesce(n, 0) < need").select("key", "need"),
                      "remaining")
        if rest.isEmpty():
            break
        found[-1] = top.join(rest, "key", "left_anti")
        remaining, opened = rest, opened * GROWTH
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _best_in_blocks(sets: DataFrame, leading: DataFrame, lexemes: DataFrame, matched: DataFrame,
                    index: SearchIndex, opened: int) -> DataFrame:
    """The best users of each set in the first blocks."""
    near = index.postings.filter(F.col("block") < opened).withColumnRenamed("kind", "token_type").drop("block")
    tokens = matched.drop("users")
    asked = leading.join(sets.select("key"), "key", "left_semi")
    candidates = asked.join(tokens, ["token_type", "lexeme"]).join(near, ["token_type", "token"]).select(
        "key", "rank").distinct()
    # the leading one is known of all candidates
    others = lexemes.filter("languages + technologies > 1 AND technologies > 0").join(
        leading.select("key", "token_type", "lexeme"), ["key", "token_type", "lexeme"], "left_anti")
    several = candidates.join(others.select("key").distinct(), "key", "left_semi")
    single = candidates.join(others.select("key").distinct(), "key", "left_anti")
    # who has them, from their tokens alone; a candidate meets only the lexemes of its own set
    held = near.join(tokens.join(others.select("token_type", "lexeme").distinct(), ["token_type", "lexeme"]),
                     ["token_type", "token"]).select("rank", "token_type", "lexeme").distinct()
    hits = several.join(others, "key").join(held, ["rank", "token_type", "lexeme"])
    checked = hits.groupBy("key", "rank").agg(
        F.bool_or((F.col("token_type") == "language") | (F.col("languages") == 0)).alias("_language"),
        F.count_if(F.col("token_type") == "technology").alias("_n"),
        F.first("technologies").alias("_all")).filter("_language AND _n = _all - 1")
    both = single.unionByName(checked.select("key", "rank")).join(sets, "key")
    return top_n_per_group(both, ["key"], [F.desc("rank")], F.col("need")).select("key", "rank")


def best_by_login(wanted: DataFrame, index: SearchIndex, common: int = COMMON_LOGINS) -> DataFrame:
    """(key, rank, score): the best ``need`` users whose login has a word of the set.

    The score is the share of the words, each weighed by how often the login repeats it.

    A user among the best has a word of at most ``common`` logins, or is among the best by the other words
    alone: having nothing else, it is only passed by users it is passed by there too. These candidates are
    scored in full. The best by common words are found once for all sets that have the same ones.
    """
    words = settle(wanted.select("key", "need", F.size("names").alias("_size"),
                                 F.explode("names.lexeme").alias("token")), "login-words")
    users = index.logins.join(words.select("token").distinct(), "token", "left_semi").groupBy("token").agg(
        F.count("*").alias("users"))
    sized = settle(words.join(users, "token"), "login-counts")
    rare = sized.filter(F.col("users") <= common).join(index.logins, "token").select("key", "rank")
    shared = sized.filter(F.col("users") > common).groupBy("key", "need", "_size").agg(
        F.array_sort(F.collect_list("token")).alias("tokens"))
    parts = shared.groupBy("tokens", "_size").agg(F.max("need").alias("need"))
    weight = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("times")), F.lit(0.0),
                         lambda acc, n: acc + 1 / (n * n))

    def scored(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys, "need", "rank").agg(F.sum(weight / F.col("_size") / REPEATED).alias("score"))

    order = [F.desc("score"), F.desc("rank")]
    hits = parts.select("*", F.explode("tokens").alias("token")).join(index.logins, "token")
    best = top_n_per_group(scored(hits, "tokens", "_size"), ["tokens", "_size"], order, F.col("need"))
    candidates = rare.unionByName(
        shared.join(best.select("tokens", "_size", "rank"), ["tokens", "_size"]).select("key", "rank")).distinct()
    full = scored(candidates.join(words, "key").join(index.logins, ["token", "rank"]), "key")
    return top_n_per_group(full, ["key"], order, F.col("need")).select("key", "rank", "score")


def best_ranked(queries: DataFrame, last: int | None, page_size: int) -> DataFrame:
    """(query_id, rank): the best ranks up to the end of the asked page.

    Ranks are 1..n without gaps, so they are counted down from the last one. Together with the
    login hits these contain every row a match-all query can show up to that page: the other rows
    among the first k are the best k by rank or fewer.
    """
    best = F.lit(last).cast("long")
    lowest = F.greatest(F.lit(1).cast("long"), best - F.col("page") * page_size + 1)
    return queries.filter(best.isNotNull()).select("query_id", F.explode(F.sequence(best, lowest)).alias("rank"))


def search_pages(queries: DataFrame, tokens: DataFrame, ranks: DataFrame, index: SearchIndex,
                 page_size: int) -> DataFrame:
    """(query_id, position, user_id, login_match, rank) of the asked page of each query.

    queries: query_id, page (from 1). A user matches by a word of the login, or by any of the languages and
    all of the technologies. Login matches come first, those of more words before others, then the better rank.
    At most the rows up to the end of a page are made for a query.
    """
    by_names, name_sets = _sets(queries, _named(tokens, "language", "technology"), page_size)
    name_sets = settle(name_sets, "name-sets")
    by_login, login_sets = _sets(queries, _named(tokens, "githubLogin"), page_size)
    open_queries = queries.join(by_names, "query_id", "left_anti")
    none = F.lit(0.0).alias("score")
    hits = (
        best_by_login(login_sets, index).join(by_login, "key").select("query_id", "rank", "score")
        .unionByName(best_by_names(name_sets, index).join(by_names, "key").select("query_id", "rank", none))
        .unionByName(best_ranked(open_queries, index.last, page_size).select("query_id", "rank", none))
    )
    matches = hits.groupBy("query_id", "rank").agg(F.max("score").alias("score")).join(
        queries.select("query_id", "page"), "query_id").withColumn(
        "login_match", (F.col("score") > 0).cast("int"))
    top = top_n_per_group(matches, ["query_id"], [F.desc("score"), F.desc("rank")], F.col("page") * page_size)
    return top.filter(F.col("position") > (F.col("page") - 1) * page_size).join(
        ranks.select("rank", "user_id"), "rank"
    ).select("query_id", "position", "user_id", "login_match", "rank")


def to_result_json(results: DataFrame) -> DataFrame:
    """(query_id, json): the result document of each query's page, at most one page of users."""
    user = F.struct(
        F.col("user_id").alias("id"), F.col("login").alias("githubLogin"),
        F.col("full_name").alias("fullName"), F.col("avg_grade").alias("avgGrade"), "grades",
        F.transform("languages", lambda x: F.struct(x.alias("language"), F.lit(True).alias("verified")))
        .alias("languages"),
        F.transform("technologies",
                    lambda x: F.struct(x.alias("technology"), F.lit(True).alias("verified")))
        .alias("technologies"),
    )
    rows = results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("position"), user.alias("user")))).alias("_rows")
    )
    return rows.select("query_id", F.to_json(F.struct(
        F.transform("_rows", lambda r: r.getField("user")).alias("users"))).alias("json"))
