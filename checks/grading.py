"""Grades, records and the warning catalog."""

from pyspark.sql import DataFrame, functions as F

from skilltide.functions.fixed import GRADE_CATEGORIES
from skilltide.operators import grade as g
from skilltide.plans.grading import grade, graded_with_technologies
from skilltide.sources import records, tables

from .adapters import CATALOG, CATALOG_LANGUAGES, Data
from .registry import query

FACTS = """
facts AS (
  SELECT user_id || '-' || ((day(ts) - 1) // 7) AS repo_id, 'repo-' || ((day(ts) - 1) // 7) AS name,
    CASE event_id % 3 WHEN 0 THEN 'JavaScript' WHEN 1 THEN 'C++' ELSE 'C' END AS language,
    event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value
  FROM events)"""
MESSAGES = FACTS + """,
messages AS (
  SELECT repo_id, name, language, 'warning' AS message_type, 'w' || (k // 10) AS message
  FROM facts WHERE event_type = 'error'
  UNION ALL
  SELECT repo_id, name, language, 'dependence', 'lib-' || (k // 5) FROM facts
  WHERE event_type = 'click'
  UNION ALL
  SELECT DISTINCT repo_id, name, 'all_languages', 'automation_tool', 'tool-' || (k // 20)
  FROM facts WHERE event_type = 'view'
  UNION ALL
  SELECT repo_id, name, 'all_languages', 'tests_dir_exists',
    CASE WHEN bool_or(event_type = 'signup' AND k < 50) THEN 'True' ELSE 'False' END
  FROM facts GROUP BY repo_id, name
  UNION ALL
  SELECT repo_id, name, language, 'lines_of_code',
    CAST(CAST(sum(CASE WHEN event_type = 'purchase' THEN floor(value) ELSE 0 END) AS BIGINT)
      AS VARCHAR)
  FROM facts GROUP BY repo_id, name, language)"""
_ROWS = ", ".join(f"('{w}', '{lang}', '{c}')" for w, c in CATALOG for lang in CATALOG_LANGUAGES)
_CATEGORIES = ", ".join(f"('{c}')" for c in GRADE_CATEGORIES)
CATALOG_SQL = f"""
catalog(warning, language, grade_category) AS (VALUES {_ROWS}),
categories(grade_category) AS (VALUES {_CATEGORIES})"""
COUNTS = """
counts AS (
  SELECT m.repo_id, m.name, m.language, c.grade_category, count(*) AS n
  FROM messages m JOIN catalog c ON c.language = m.language AND c.warning = m.message
  WHERE m.message_type = 'warning' GROUP BY ALL)"""
VALUES = """
language_values AS (
  SELECT l.repo_id, l.name, l.language, k.grade_category, CAST(l.message AS BIGINT) AS loc,
    CASE WHEN CAST(l.message AS BIGINT) = 0 THEN 0.0
      ELSE greatest(0.0, 1 - coalesce(c.n, 0) / CAST(l.message AS DOUBLE)) END AS value
  FROM messages l CROSS JOIN categories k
  LEFT JOIN counts c ON c.repo_id = l.repo_id AND c.name = l.name AND c.language = l.language
    AND c.grade_category = k.grade_category
  WHERE l.message_type = 'lines_of_code')"""
PENALTIES = """
automation AS (
  SELECT repo_id, name, 'Automated' AS grade_category,
    -greatest(0.0, 3.0 - count(*) FILTER (message_type = 'automation_tool')) / 3.0 AS value
  FROM messages GROUP BY repo_id, name),
testable AS (
  SELECT repo_id, name, 'Testable' AS grade_category,
    CASE message WHEN 'True' THEN 0.0 ELSE -1.0 END AS value
  FROM messages WHERE message_type = 'tests_dir_exists')"""
GRADES = """
parts AS (
  SELECT repo_id, name, grade_category, sum(loc) AS loc, avg(value) AS value
  FROM language_values GROUP BY ALL
  UNION ALL SELECT repo_id, name, grade_category, 0, value FROM automation
  UNION ALL SELECT repo_id, name, grade_category, 0, value FROM testable),
grades AS (
  SELECT repo_id, name, grade_category,
    round(greatest(0.0, least(1.0, sum(value))), 6) AS value, CAST(sum(loc) AS BIGINT) AS lines_of_code
  FROM parts GROUP BY ALL)"""
ALL_GRADES = f"WITH {MESSAGES}, {CATALOG_SQL}, {COUNTS}, {VALUES}, {PENALTIES}, {GRADES}"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(ALL_GRADES + " SELECT * FROM grades")
def grade_repositories(d: Data) -> DataFrame:
    return rounded(grade(d.messages, d.catalog), "value")


@query(f"""WITH {MESSAGES}, {CATALOG_SQL}, {COUNTS}
SELECT p.repo_id, p.name, p.language, k.grade_category, coalesce(c.n, 0) AS warnings
FROM (SELECT DISTINCT repo_id, name, language FROM messages) p CROSS JOIN categories k
LEFT JOIN counts c ON c.repo_id = p.repo_id AND c.name = p.name AND c.language = p.language
  AND c.grade_category = k.grade_category""")
def warning_counts_zero_filled(d: Data) -> DataFrame:
    return g.warning_counts(d.messages, d.catalog)


@query(f"""WITH {MESSAGES}, {CATALOG_SQL}, {COUNTS}, {VALUES}
SELECT repo_id, name, grade_category, CAST(sum(loc) AS BIGINT) AS lines_of_code,
  round(avg(value), 6) AS value
FROM language_values GROUP BY ALL""")
def category_values(d: Data) -> DataFrame:
    return rounded(g.category_values(g.language_values(d.messages, d.catalog)), "value")


@query(f"WITH {MESSAGES}, {PENALTIES} "
       "SELECT repo_id, name, grade_category, round(value, 6) AS value FROM automation")
def automation_penalty(d: Data) -> DataFrame:
    return rounded(g.automation_penalty(d.messages), "value")


@query(f"WITH {MESSAGES}, {PENALTIES} SELECT * FROM testable")
def testable_penalty(d: Data) -> DataFrame:
    return g.testable_penalty(d.messages)


@query(f"""WITH {MESSAGES}, {PENALTIES}
SELECT repo_id, name, grade_category, round(value, 6) AS value
FROM (FROM automation UNION ALL FROM testable)""")
def union_penalties(d: Data) -> DataFrame:
    both = g.automation_penalty(d.messages).unionByName(g.testable_penalty(d.messages))
    return rounded(both, "value")


@query(f"""WITH {MESSAGES}
SELECT DISTINCT repo_id, name, language, message AS technology FROM messages
WHERE message_type = 'dependence'""")
def dependencies_by_language(d: Data) -> DataFrame:
    return g.dependencies_of(d.messages)


@query(ALL_GRADES + """,
lists AS (
  SELECT repo_id, name, lines_of_code,
    string_agg(grade_category || '=' || CAST(round(value * 1000000) AS BIGINT), ','
      ORDER BY grade_category) AS grades
  FROM grades GROUP BY ALL)
SELECT l.repo_id, l.name, l.lines_of_code, l.grades, t.language, t.technologies
FROM lists l JOIN (
  SELECT repo_id, name, language, string_agg(DISTINCT message, ',' ORDER BY message) AS technologies
  FROM messages WHERE message_type = 'dependence' GROUP BY ALL) t
ON t.repo_id = l.repo_id AND t.name = l.name""")
def graded_with_technologies_text(d: Data) -> DataFrame:
    rows = graded_with_technologies(grade(d.messages, d.catalog), d.messages)
    grades = F.transform("grades", lambda x: F.concat(
        x["grade_category"], F.lit("="), F.round(x["value"] * 1000000).cast("long").cast("string")))
    return rows.select(
        "repo_id", "name", "lines_of_code", F.array_join(grades, ",").alias("grades"),
        F.explode("language_to_technologies").alias("language", "t"),
    ).select("repo_id", "name", "lines_of_code", "grades", "language",
             F.array_join("t", ",").alias("technologies"))


@query(f"""WITH {FACTS}, records AS (
  SELECT repo_id || ';' || name || ';' || language || ';' || event_type || ';' ||
    CASE WHEN k < 10 THEN '' WHEN k < 20 THEN 'a;b' ELSE k::VARCHAR END ||
    CASE WHEN k >= 90 THEN ';' ELSE '' END AS value
  FROM facts),
parts AS (SELECT string_split(regexp_replace(value, ';+$', ''), ';') AS p FROM records)
SELECT p[1] AS repo_id, p[2] AS name, p[3] AS language, p[4] AS message_type, p[5] AS message
FROM parts WHERE len(p) = 5""")
def delimited_scan(d: Data) -> DataFrame:
    k = F.col("k")
    message = F.when(k < 10, "").when(k < 20, "a;b").otherwise(k.cast("string"))
    lines = d.event_facts.select(F.concat_ws(
        ";", "repo_id", "name", "language", "event_type",
        F.concat(message, F.when(k >= 90, ";").otherwise(""))).alias("value"))
    return records.parse_records(lines)


@query("""SELECT p_partkey || ';' || p_name || ';' || p_type || ';https://host/' || p_partkey || ';' ||
  CASE WHEN p_brand = 'Brand#1' THEN p_brand ELSE p_brand || ',Brand#1' END AS value
FROM part""")
def worklist_records(d: Data) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    return records.format_worklist(d.table("part").select(
        key.alias("repo_id"), F.col("p_name").alias("name"), F.col("p_type").alias("owner_login"),
        F.concat(F.lit("https://host/"), key).alias("archive_url"),
        F.array("p_brand").alias("languages"), F.lit("Brand#1").alias("primary_language")))


@query("""SELECT p_name AS warning, n_name AS language, r_name AS grade_category
FROM part JOIN nation ON n_nationkey = p_size % 25 JOIN region ON r_regionkey = p_partkey % 5""")
def catalog_star_join(d: Data) -> DataFrame:
    return tables.warning_catalog(
        d.table("part").select(
            F.col("p_name").alias("warning"), (F.col("p_partkey") % 5).alias("grade_category_id"),
            (F.col("p_size") % 25).alias("language_id")),
        d.table("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("category")),
        d.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("language")))


@query("SELECT r_name AS grade_category FROM region")
def broadcast_categories(d: Data) -> DataFrame:
    return tables.grade_categories(d.table("region").withColumnRenamed("r_name", "category"))


@query("""SELECT repo_id, name, language, message FROM (
  SELECT CAST(user_id AS VARCHAR) AS repo_id, 'n' AS name, event_type AS message_type,
    'any' AS language, props AS message FROM events)
WHERE message_type = 'click'""")
def message_filters(d: Data) -> DataFrame:
    rows = d.table("events").select(
        F.col("user_id").cast("string").alias("repo_id"), F.lit("n").alias("name"),
        F.lit("any").alias("language"), F.col("event_type").alias("message_type"),
        F.col("props").alias("message"))
    return g.messages_of(rows, "click")
