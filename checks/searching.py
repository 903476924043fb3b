"""Lexemes, tokens, search pages, suggestions, synonyms and places."""

from pyspark.sql import DataFrame, functions as F

from skilltide.functions import text as tx
from skilltide.functions.fixed import STOP_WORDS, TOKEN_TYPES
from skilltide.operators import locations, names, suggest as sg, tokens as t
from skilltide.operators.synonyms import synonym_flags, technology_synonyms as synonyms
from skilltide.plans import ranking, searching

from .adapters import Data
from .ranking import TABLES
from .registry import query

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
STRIP = "regexp_extract(x, '^([.,;''\"]*)(.+?)([.,;''\"]*)$', 2)"
SPLIT = r"string_split_regex(regexp_replace(lower(text), '[\s/\\]+$', ''), '[\s/\\]+')"
LEXEMES = f"list_filter(list_transform({SPLIT}, lambda x: {STRIP}), lambda x: x <> '')"
QUERIES = """
queries AS (
  SELECT conv_id || '-' || turn AS query_id, text || ' ' || n_name AS text
  FROM conversations JOIN nation ON conv_id % 25 = n_nationkey)"""
WORDS = QUERIES + f""",
words AS (
  SELECT query_id, unnest(l) AS lexeme, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT query_id, {LEXEMES} AS l FROM queries))"""
NAMES = """
names AS (
  SELECT DISTINCT 'language' AS token_type, lang AS name, NULL AS language FROM documents
  UNION ALL
  SELECT DISTINCT 'technology', regexp_extract(text, '^([A-Za-z]+)', 1), lang FROM documents
  WHERE regexp_extract(text, '^([A-Za-z]+)', 1) <> ''
  UNION ALL SELECT 'githubLogin', replace(c_name, 'Customer#', 'user'), NULL FROM customer)"""
NAMED = WORDS + "," + NAMES + """,
named AS (
  SELECT query_id, token_type, lower(name) AS lexeme
  FROM names n JOIN (SELECT DISTINCT query_id, lexeme FROM words) w ON lower(n.name) = w.lexeme)"""
UNKNOWN = NAMED + f""",
unknown AS (
  SELECT * FROM words WHERE lexeme NOT IN ({_STOP})
    AND lexeme NOT IN (SELECT lower(name) FROM names))"""
GAZETTEER = """
gazetteer AS (
  SELECT lower(n_name) AS alias, 3 AS weight, n_name AS city, r_name AS country,
    n_nationkey AS population
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT lower(r_name), 1, NULL, r_name, 0 FROM region
  UNION ALL SELECT lower(left(r_name, 2)), 2, NULL, r_name, 0 FROM region)"""


def place_sql(source: str, key: str, column: str) -> str:
    """Best place of each text: single words and pairs of words looked up."""
    return f"""
place_words AS (
  SELECT {key}, list_filter(string_split_regex(lower({column}), '[\\s,;/]+'), lambda x: x <> '') AS w
  FROM {source}),
runs AS (
  SELECT DISTINCT {key}, unnest(w || list_transform(generate_series(1, len(w) - 1),
    lambda i: w[i] || ' ' || w[i + 1])) AS alias FROM place_words),
places AS (
  SELECT {key}, city, country FROM (
    SELECT *, row_number() OVER (PARTITION BY {key}
      ORDER BY weight DESC, population DESC, alias, country) AS rn
    FROM runs JOIN gazetteer USING (alias)) WHERE rn = 1)"""


def joined(column: str):
    return F.array_join(column, " ")


@query(f"WITH {QUERIES} SELECT query_id, array_to_string({LEXEMES}, ' ') AS lexemes FROM queries")
def extract_lexemes(d: Data) -> DataFrame:
    return d.conversation_queries.select(
        "query_id", joined(tx.extract_lexemes(F.col("text"))).alias("lexemes"))


@query(f"""SELECT doc_id, array_to_string(list_filter(
  list_transform(s[greatest(1, len(s) - 9):], lambda x: {STRIP}), lambda x: x <> ''), ' ') AS lexemes
FROM (SELECT doc_id, {SPLIT} AS s FROM documents)""")
def last_lexemes(d: Data) -> DataFrame:
    return d.documents.select(
        "doc_id", joined(tx.extract_lexemes(F.col("text"), 10)).alias("lexemes"))


@query(f"WITH {WORDS} SELECT query_id, 'stopWord' AS token_type, lexeme FROM words "
       f"WHERE lexeme IN ({_STOP})")
def stop_words(d: Data) -> DataFrame:
    return t.stop_words(t.query_lexemes(d.conversation_queries))


@query(f"WITH {UNKNOWN} SELECT query_id, pos, lexeme FROM unknown")
def unknown_lexemes(d: Data) -> DataFrame:
    return t.unknown_lexemes(
        t.query_lexemes(d.conversation_queries), searching.stored_names(d.text_tables))


@query(f"""WITH {UNKNOWN}, {GAZETTEER},
rest AS (SELECT query_id, string_agg(lexeme, ' ' ORDER BY pos) AS text FROM unknown GROUP BY ALL),
{place_sql('rest', 'query_id', 'text')}
SELECT query_id, 'stopWord' AS token_type, lexeme FROM words WHERE lexeme IN ({_STOP})
UNION ALL SELECT * FROM named
UNION ALL SELECT query_id, 'city', city FROM places WHERE city IS NOT NULL
UNION ALL SELECT query_id, 'country', country FROM places""")
def tokenize_queries(d: Data) -> DataFrame:
    return searching.tokenize(d.conversation_queries, d.text_tables, d.gazetteer)


@query(f"""WITH {NAMED}, lists AS (
  SELECT query_id, string_agg(lexeme, ' ' ORDER BY lexeme) AS lexemes, token_type
  FROM named GROUP BY ALL)
SELECT q.query_id, k.token_type, coalesce(l.lexemes, '') AS lexemes
FROM queries q CROSS JOIN (SELECT unnest({TOKEN_TYPES!r}) AS token_type) k
LEFT JOIN lists l ON l.query_id = q.query_id AND l.token_type = k.token_type""")
def token_map(d: Data) -> DataFrame:
    queries = d.conversation_queries
    found = t.named_tokens(t.query_lexemes(queries), searching.stored_names(d.text_tables))
    return t.token_map(queries, found).select(
        "query_id", F.explode("tokens").alias("token_type", "l")
    ).select("query_id", "token_type", joined("l").alias("lexemes"))


_TOKENS = f"""list_filter(list_distinct(list_concat(
  string_split_regex(lower(text), '\\s+'),
  flatten(list_transform(string_split_regex(lower(text), '\\s+'),
    lambda w: string_split_regex(w, '[-_.]'))))), lambda t: t <> '' AND t NOT IN ({_STOP}))"""


@query(f"""SELECT doc_id, array_to_string(list_sort({_TOKENS}), ' ') AS tokens,
  list_has_any({_TOKENS}, ['nation', 'est', 'thaner']) AS any_word,
  length(list_filter({_TOKENS}, lambda t: starts_with(t, 'th'))) > 0
    AND length(list_filter({_TOKENS}, lambda t: starts_with(t, 'on'))) > 0 AS all_prefixes
FROM documents""")
def token_arrays(d: Data) -> DataFrame:
    rows = d.documents.select("doc_id", tx.text_tokens(F.col("text")).alias("t"))
    return rows.select(
        "doc_id", joined(F.array_sort("t")).alias("tokens"),
        tx.match_any(F.col("t"), F.array(F.lit("nation"), F.lit("est"), F.lit("thaner")))
        .alias("any_word"),
        tx.match_all_prefix(F.col("t"), F.array(F.lit("th"), F.lit("on"))).alias("all_prefixes"))


@query("""SELECT p_partkey, p_name ILIKE '%BOLT' OR p_name ILIKE 'red_widget' AS live,
  lower(p_name) IN ('%bolt', 'red_widget', 'red bolt') AS plain FROM part""")
def ilike_any(d: Data) -> DataFrame:
    live = F.array(F.lit("%BOLT"), F.lit("red_widget"))
    plain = F.array(F.lit("%BOLT"), F.lit("red_widget"), F.lit("Red Bolt"))
    return d.table("part").select(
        "p_partkey", tx.ilike_any(F.col("p_name"), live).alias("live"),
        tx.ilike_any(F.col("p_name"), plain, escape=True).alias("plain"))


@query("""SELECT p_partkey, p_name ILIKE left(p_type, 1) || '%' AS live,
  starts_with(lower(p_name), lower(left(p_type, 1))) AS plain FROM part""")
def prefix_match(d: Data) -> DataFrame:
    start = F.substring("p_type", 1, 1)
    return d.table("part").select(
        "p_partkey", tx.prefix_match(F.col("p_name"), start).alias("live"),
        tx.prefix_match(F.col("p_name"), start, escape=True).alias("plain"))


@query("""SELECT DISTINCT p.p_name AS pattern_of, n.name
FROM (SELECT DISTINCT p_name, replace(p_name, ' ', '_') AS pattern FROM part) p
JOIN (SELECT DISTINCT replace(p_name, ' ', '-') AS name FROM part) n ON n.name ILIKE p.pattern
UNION ALL
SELECT DISTINCT p.p_name, n.name
FROM (SELECT DISTINCT p_name, '%' || split_part(p_name, ' ', 2) AS pattern FROM part) p
JOIN (SELECT DISTINCT replace(p_name, ' ', '-') AS name FROM part) n ON n.name ILIKE p.pattern""")
def wildcard_name_join(d: Data) -> DataFrame:
    part = d.table("part").select("p_name").distinct()
    stored = part.select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("name"))
    first = part.select(F.col("p_name").alias("pattern_of"),
                        F.replace("p_name", F.lit(" "), F.lit("_")).alias("lexeme"))
    second = part.select(F.col("p_name").alias("pattern_of"),
                         F.concat(F.lit("%"), F.split("p_name", " ")[1]).alias("lexeme"))
    return names.match_names(first.unionByName(second), stored).drop("lexeme")


@query("""WITH patterns AS (
  SELECT c_custkey, unnest(['%' || right(c_name, 4) || '%', 'customer#%' || right(c_name, 3),
    '%#____' || substr(c_name, 14, 4) || '_']) AS pattern FROM customer),
names AS (SELECT lower(c_name) AS name FROM customer UNION SELECT s_name FROM supplier)
SELECT DISTINCT c_custkey, pattern, name FROM patterns JOIN names ON name ILIKE pattern""")
def wildcard_login_join(d: Data) -> DataFrame:
    """Wildcards anywhere, asked by every customer of all names; most runs are shared by all names."""
    own = F.col("c_name")
    customer = d.table("customer")
    patterns = customer.select("c_custkey", F.explode(F.array(
        F.concat(F.lit("%"), F.right(own, F.lit(4)), F.lit("%")),
        F.concat(F.lit("customer#%"), F.right(own, F.lit(3))),
        F.concat(F.lit("%#____"), F.substring(own, 14, 4), F.lit("_")))).alias("pattern")).distinct()
    stored = customer.select(F.lower(own).alias("name")).union(d.table("supplier").select("s_name")).distinct()
    # both sides are distinct, and so are their pairs: far more rows, which no shuffle has to sort
    return names.match_names(patterns, stored, "pattern")


# --- places ---

@query(f"""WITH {GAZETTEER}, texts AS (
  SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN r_name WHEN 'MACHINERY' THEN 'nowhere'
    WHEN 'FURNITURE' THEN left(r_name, 2) || '; ' || r_name ELSE n_name || ', ' || r_name END AS text
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
{place_sql('texts', 'c_custkey', 'text')}
SELECT t.c_custkey, p.country, p.city FROM texts t LEFT JOIN places p USING (c_custkey)""")
def location_resolve(d: Data) -> DataFrame:
    nation, region = d.table("nation"), d.table("region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    segment = F.col("c_mktsegment")
    texts = d.table("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey",
        F.when(segment == "BUILDING", F.col("r_name")).when(segment == "MACHINERY", "nowhere")
        .when(segment == "FURNITURE", F.concat(F.substring("r_name", 1, 2), F.lit("; "), "r_name"))
        .otherwise(F.concat("n_name", F.lit(", "), "r_name")).alias("text"))
    return locations.resolve_location(texts, ["c_custkey"], "text", d.gazetteer)


# --- synonyms ---

SYNONYM_NAMES = """
names AS (
  SELECT DISTINCT p_brand AS language, unnest([replace(p_name, ' ', '-'), split_part(p_name, ' ', 1),
    split_part(p_name, ' ', 2), replace(p_name, ' ', '_') || '.js']) AS technology FROM part)"""
MATCHES = """
matches AS (
  SELECT y.language, y.technology AS synonym, x.technology AS stem, row_number() OVER (
    PARTITION BY y.language, y.technology ORDER BY length(x.technology), x.technology) AS rn
  FROM names y JOIN names x ON x.language = y.language AND x.technology <> y.technology
    AND contains(y.technology, x.technology)
  WHERE length(x.technology) >= 4 AND length(y.technology) >= 4
    AND regexp_matches(y.technology, '[-_.]') AND y.language NOT IN ('Brand#1', 'Brand#2'))"""
_STEMS = """
SELECT language, stem, synonym FROM matches WHERE rn = 1
UNION ALL
SELECT language, technology, NULL FROM names n
WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.language = n.language
  AND m.synonym = n.technology)"""


def synonym_names(d: Data) -> DataFrame:
    words = F.split("p_name", " ")
    return d.table("part").select(F.col("p_brand").alias("language"), F.explode(F.array(
        F.replace("p_name", F.lit(" "), F.lit("-")), words[0], words[1],
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".js")),
    )).alias("technology"))


def managed_brands() -> list[str]:
    return [f"Brand#{i}" for i in range(3, 100)]


@query(f"WITH {SYNONYM_NAMES}, {MATCHES} {_STEMS}")
def technology_synonyms(d: Data) -> DataFrame:
    return synonyms(synonym_names(d), managed_brands())


@query(f"WITH {SYNONYM_NAMES}, {MATCHES}, stems AS ({_STEMS}) "
       "SELECT language, coalesce(synonym, stem) AS technology, synonym IS NOT NULL AS synonym "
       "FROM stems")
def technology_synonym_flags(d: Data) -> DataFrame:
    return synonym_flags(synonyms(synonym_names(d), managed_brands()))


@query(f"""WITH {SYNONYM_NAMES}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY language ORDER BY technology) AS n FROM names),
matches AS (
  SELECT y.language, y.technology AS synonym, x.technology AS stem, row_number() OVER (
    PARTITION BY y.language, y.technology ORDER BY length(x.technology), x.technology) AS rn
  FROM numbered y JOIN numbered x ON x.language = y.language AND x.technology <> y.technology
    AND contains(y.technology, x.technology)
  WHERE length(x.technology) >= 4 AND length(y.technology) >= 4 AND x.n <= 40 AND y.n <= 40
    AND regexp_matches(y.technology, '[-_.]') AND y.language NOT IN ('Brand#1', 'Brand#2'))
{_STEMS}""")
def technology_synonyms_first_items(d: Data) -> DataFrame:
    return synonyms(synonym_names(d), managed_brands(), max_items=40)


# --- search: one query per brand and kind, asked of all users ---

SEARCH = TABLES + """,
technologies AS (SELECT DISTINCT p_brand AS language, replace(p_name, ' ', '-') AS technology FROM part),
languages AS (SELECT DISTINCT language FROM technologies),
user_words AS (
  SELECT user_id, list(DISTINCT lower(language)) AS langs,
    list_distinct(list(lower(technology)) || list(split_part(lower(technology), '-', 1))
      || list(split_part(lower(technology), '-', 2))) AS techs
  FROM verified GROUP BY user_id)"""


def search_sql(queries: str) -> str:
    return f"""WITH {SEARCH},
queries AS ({queries}),
words AS (SELECT query_id, page, unnest(string_split(lower(text), ' ')) AS w FROM queries),
tokens AS (
  SELECT q.query_id, any_value(q.page) AS page,
    list(DISTINCT w) FILTER (w IN (SELECT lower(language) FROM languages)) AS l,
    list(DISTINCT w) FILTER (w IN (SELECT lower(technology) FROM technologies)) AS t,
    list(DISTINCT w) FILTER (w IN (SELECT login FROM users)) AS u
  FROM words q GROUP BY q.query_id),
matches AS (
  SELECT query_id, page, user_id, rank,
    CASE WHEN u IS NOT NULL AND list_contains(u, login) THEN 1 ELSE 0 END AS login_match
  FROM tokens, ranks JOIN user_words USING (user_id)
  WHERE u IS NOT NULL AND list_contains(u, login)
    OR ((l IS NULL OR list_has_any(langs, l)) AND (t IS NULL OR len(list_filter(t,
      lambda p: len(list_filter(techs, lambda x: starts_with(x, p))) > 0)) = len(t)))),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY login_match DESC, rank DESC) AS position
  FROM matches)
SELECT query_id, position, user_id, login_match, rank FROM placed
WHERE position > (page - 1) * 20 AND position <= page * 20"""


def search(d: Data, queries: DataFrame) -> DataFrame:
    tables = ranking.with_verified(d.tables)
    ranks = ranking.rank_users(tables)
    return searching.search(queries, ranks, searching.search_index(tables, ranks), tables)


def brands(d: Data) -> DataFrame:
    return d.table("part").select("p_brand").distinct()


@query(search_sql("SELECT DISTINCT p_brand AS query_id, p_brand || ' the' AS text, 1 AS page FROM part"))
def search_by_language(d: Data) -> DataFrame:
    return search(d, brands(d).select(
        F.col("p_brand").alias("query_id"), F.concat("p_brand", F.lit(" the")).alias("text"),
        F.lit(1).alias("page")))


@query(search_sql("""SELECT DISTINCT p_name AS query_id,
  replace(p_name, ' ', '-') || ' small-ring' AS text, 1 AS page FROM part"""))
def search_by_technology_prefix(d: Data) -> DataFrame:
    return search(d, d.table("part").select("p_name").distinct().select(
        F.col("p_name").alias("query_id"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(" small-ring")).alias("text"),
        F.lit(1).alias("page")))


@query(search_sql("""SELECT CAST(c_custkey AS VARCHAR) AS query_id,
  replace(c_name, 'Customer#', 'USER') AS text, 1 AS page FROM customer"""))
def search_by_login(d: Data) -> DataFrame:
    return search(d, d.table("customer").select(
        F.col("c_custkey").cast("string").alias("query_id"),
        F.replace("c_name", F.lit("Customer#"), F.lit("USER")).alias("text"),
        F.lit(1).alias("page")))


SEGMENT_LOGIN = """lower(c_mktsegment) || CASE WHEN c_custkey % 50 = 0 THEN '' ELSE '-' || c_custkey END"""


@query(f"""WITH {TABLES}, logins AS (SELECT c_custkey AS user_id, {SEGMENT_LOGIN} AS login FROM customer),
queries AS (
  SELECT DISTINCT c_mktsegment AS query_id, c_mktsegment AS text, 2 AS page FROM customer
  UNION ALL SELECT 'one ' || c_custkey, {SEGMENT_LOGIN} || ' ' || c_mktsegment, 1 FROM customer
  WHERE c_custkey % 97 = 1),
words AS (SELECT DISTINCT query_id, page, unnest(string_split(lower(text), ' ')) AS w FROM queries),
asked AS (SELECT * FROM words WHERE w IN (SELECT login FROM logins)),
matches AS (
  SELECT query_id, q.page, r.user_id, rank, (SELECT count(*) FROM asked a WHERE a.query_id = q.query_id
    AND list_contains(list_distinct([l.login, split_part(l.login, '-', 1), split_part(l.login, '-', 2)]), a.w)) AS n
  FROM queries q, ranks r JOIN logins l ON l.user_id = r.user_id),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, rank DESC) AS position FROM matches)
SELECT query_id, position, user_id, CAST(n > 0 AS INT) AS login_match, rank FROM placed
WHERE position > (page - 1) * 20 AND position <= page * 20""")
def search_login_words(d: Data) -> DataFrame:
    """Words of logins: every customer has the segment in the login, some have nothing else."""
    customer = d.table("customer")
    login = F.expr(SEGMENT_LOGIN)
    names = customer.select(F.col("c_custkey").alias("user_id"), login.alias("login"))
    tables = {name: d.tables[name] for name in d.tables}
    tables["users"] = tables["users"].drop("login").join(names, "user_id")
    ranks = ranking.rank_users(tables)
    queries = customer.select(
        F.col("c_mktsegment").alias("query_id"), F.col("c_mktsegment").alias("text"), F.lit(2).alias("page")
    ).distinct().unionByName(customer.filter("c_custkey % 97 = 1").select(
        F.concat(F.lit("one "), F.col("c_custkey")).alias("query_id"),
        F.concat_ws(" ", login, "c_mktsegment").alias("text"), F.lit(1).alias("page")))
    return searching.search(queries, ranks, searching.search_index(tables, ranks), tables)


@query(search_sql("""SELECT n_name AS query_id,
  'Brand#' || (n_nationkey + 1) || ' red-bolt' AS text, 2 AS page FROM nation
UNION ALL SELECT r_name, 'nothing known', 3 FROM region"""))
def search_page2(d: Data) -> DataFrame:
    first = d.table("nation").select(
        F.col("n_name").alias("query_id"),
        F.concat(F.lit("Brand#"), (F.col("n_nationkey") + 1).cast("string"), F.lit(" red-bolt"))
        .alias("text"), F.lit(2).alias("page"))
    return search(d, first.unionByName(d.table("region").select(
        F.col("r_name").alias("query_id"), F.lit("nothing known").alias("text"),
        F.lit(3).alias("page"))))


@query(f"""WITH found AS (
  {search_sql("SELECT DISTINCT p_brand AS query_id, p_brand AS text, 1 AS page FROM part")}),
{TABLES},
lists AS (
  SELECT user_id, string_agg(DISTINCT language, ',' ORDER BY language) AS languages,
    string_agg(DISTINCT technology, ',' ORDER BY technology) AS technologies
  FROM verified GROUP BY user_id),
averages AS (SELECT user_id, round(avg(value), 9) AS avg_grade,
  string_agg(category, ',' ORDER BY category) AS categories FROM means GROUP BY user_id)
SELECT query_id, position - 1 AS position, user_id AS id, login, full_name, avg_grade, categories,
  languages, technologies
FROM found JOIN users USING (user_id) JOIN lists USING (user_id) JOIN averages USING (user_id)""")
def search_json(d: Data) -> DataFrame:
    queries = brands(d).select(F.col("p_brand").alias("query_id"), F.col("p_brand").alias("text"),
                               F.lit(1).alias("page"))
    tables = ranking.with_verified(d.tables)
    ranks = ranking.rank_users(tables)
    results = searching.search(queries, ranks, searching.search_index(tables, ranks), tables)
    documents = searching.search_documents(results, ranks, tables)
    schema = ("users ARRAY<STRUCT<id: BIGINT, githubLogin: STRING, fullName: STRING, "
              "avgGrade: DOUBLE, grades: ARRAY<STRUCT<category: STRING, value: DOUBLE>>, "
              "languages: ARRAY<STRUCT<language: STRING, verified: BOOLEAN>>, "
              "technologies: ARRAY<STRUCT<technology: STRING, verified: BOOLEAN>>>>")
    return documents.select(
        "query_id", F.posexplode(F.from_json("json", schema).getField("users")).alias("position", "u")
    ).select(
        "query_id", "position", "u.id", F.col("u.githubLogin").alias("login"),
        F.col("u.fullName").alias("full_name"), F.round("u.avgGrade", 9).alias("avg_grade"),
        F.array_join("u.grades.category", ",").alias("categories"),
        F.array_join("u.languages.language", ",").alias("languages"),
        F.array_join("u.technologies.technology", ",").alias("technologies"))


# --- suggestions ---

def suggest_sql(queries: str) -> str:
    return f"""WITH {TABLES},
technologies AS (
  SELECT p_brand AS language, replace(p_name, ' ', '-') AS technology, bool_or(p_size > 40) AS synonym
  FROM part GROUP BY ALL),
languages AS (SELECT DISTINCT language FROM technologies),
asked AS (
  SELECT query_id, l[:len(l) - 1] AS prefix, l[len(l)] AS lexeme
  FROM (SELECT query_id, string_split(lower(text), ' ') AS l FROM ({queries}))),
branches AS (
  SELECT DISTINCT query_id, 't' AS branch, lower(technology) AS suggestion,
    (2 + CAST(len(list_filter(prefix, lambda p: t.language ILIKE p)) > 0 AS INTEGER))
      * CAST(NOT synonym AS INTEGER) AS priority, length(technology) AS length
  FROM asked JOIN technologies t ON technology ILIKE lexeme || '%'
  UNION ALL SELECT DISTINCT query_id, 'l', lower(language), 2, length(language)
  FROM asked JOIN languages ON language ILIKE lexeme || '%'
  UNION ALL SELECT DISTINCT query_id, 'c', lower(n_name), 1, length(n_name)
  FROM asked JOIN nation ON n_name ILIKE lexeme || '%'
  UNION ALL SELECT DISTINCT query_id, 'r', lower(r_name), 1, length(r_name)
  FROM asked JOIN region ON r_name ILIKE lexeme || '%'),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, branch
    ORDER BY priority DESC, length, suggestion) AS n FROM branches) WHERE n <= 10),
top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY priority DESC, length, suggestion) AS pos FROM best) WHERE pos <= 10)
SELECT query_id, pos, array_to_string(prefix || [suggestion], ' ') AS suggestion
FROM top JOIN asked USING (query_id) WHERE NOT list_contains(prefix, suggestion)"""


@query(suggest_sql("""SELECT DISTINCT left(p_name, 1) AS query_id, left(p_name, 1) AS text FROM part
  UNION SELECT DISTINCT left(r_name, 2), left(r_name, 2) FROM region
  UNION SELECT 'n', 'n' UNION SELECT 'b', 'b'"""))
def suggest_prefix(d: Data) -> DataFrame:
    def start(table: str, column: str, n: int) -> DataFrame:
        return d.table(table).select(F.substring(column, 1, n).alias("text"))

    texts = start("part", "p_name", 1).unionByName(start("region", "r_name", 2)).unionByName(
        start("nation", "n_name", 1).select(F.lower("text").alias("text"))).unionByName(
        start("part", "p_brand", 1).select(F.lower("text").alias("text"))).distinct()
    return searching.suggest(texts.select(F.col("text").alias("query_id"), "text"), d.tables)


@query(suggest_sql("""SELECT DISTINCT p_brand || ' ' || p_name AS query_id,
  p_brand || ' ' || replace(p_name, ' ', '-') || ' ' || left(p_name, 3) || '_' AS text FROM part"""))
def suggest_with_language(d: Data) -> DataFrame:
    queries = d.table("part").select(
        F.concat_ws(" ", "p_brand", "p_name").alias("query_id"),
        F.concat_ws(" ", "p_brand", F.replace("p_name", F.lit(" "), F.lit("-")),
                    F.concat(F.substring("p_name", 1, 3), F.lit("_"))).alias("text")).distinct()
    return searching.suggest(queries, d.tables)


@query(f"""WITH found AS ({suggest_sql("""SELECT DISTINCT p_brand || ' ' || left(p_name, 2) AS query_id,
  p_brand || ' ' || left(p_name, 2) AS text FROM part""")})
SELECT query_id, string_agg(suggestion, ',' ORDER BY pos) AS suggestions FROM found GROUP BY ALL""")
def suggest_json(d: Data) -> DataFrame:
    queries = d.table("part").select(
        F.concat_ws(" ", "p_brand", F.substring("p_name", 1, 2)).alias("text")).distinct()
    queries = queries.select(F.col("text").alias("query_id"), "text")
    documents = searching.suggestion_documents(searching.suggest(queries, d.tables), queries)
    texts = F.from_json("json", "suggestions ARRAY<STRING>").getField("suggestions")
    return documents.select("query_id", F.array_join(texts, ",").alias("suggestions"))


@query("""SELECT p_partkey, p_brand || ' the ' || p_name AS completed FROM part""")
def completed_text(d: Data) -> DataFrame:
    words = F.array("p_brand", F.lit("the"))
    return d.table("part").select("p_partkey", tx.complete(words, F.col("p_name")).alias("completed"))


@query(f"""WITH {QUERIES}, split AS (SELECT query_id, {LEXEMES} AS l FROM queries)
SELECT query_id, array_to_string(l[:len(l) - 1], ' ') AS prefix, l[len(l)] AS lexeme
FROM split WHERE len(l) > 0""")
def split_queries(d: Data) -> DataFrame:
    return sg.split_queries(d.conversation_queries).withColumn("prefix", joined("prefix"))
