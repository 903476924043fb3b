"""Figures per developer, the ranking and the pages made from it."""

from pyspark.sql import DataFrame, functions as F

from skilltide.operators import rank as r
from skilltide.operators import ranked
from skilltide.plans import ranking
from skilltide.plans.standings import Standings
from skilltide.storage import new_path, settle, small_broadcasts

from .adapters import Data
from .registry import query

TABLES = """
repositories AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS raw_id, o_custkey AS user_id, 'repo-' || o_orderkey AS name,
    CAST(floor(o_totalprice) AS BIGINT) % 10000 AS lines_of_code, o_orderdate AS updated
  FROM orders),
grades AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'Maintainable' WHEN 'N' THEN 'Robust' ELSE 'Secure' END
    AS category, CAST(l_orderkey AS VARCHAR) AS raw_id,
    1 - round(max(l_discount) * 100) / 128 AS value
  FROM lineitem GROUP BY ALL),
users AS (
  SELECT c_custkey AS user_id, replace(c_name, 'Customer#', 'user') AS login, c_name AS full_name
  FROM customer),
developers AS (
  SELECT c_custkey AS user_id, c_acctbal > 0 AS job_seeker, c_mktsegment AS description
  FROM customer WHERE c_mktsegment <> 'MACHINERY'),
settings AS (
  SELECT p_brand AS language, replace(p_name, ' ', '-') AS technology, o_custkey AS user_id,
    bool_or(l_linestatus = 'F') AS verified
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  GROUP BY ALL),
verified AS (
  SELECT user_id, language, technology FROM settings
  WHERE verified AND user_id IN (SELECT user_id FROM developers)),
graded AS (SELECT user_id, category, value FROM grades JOIN repositories USING (raw_id)),
means AS (SELECT user_id, category, avg(value) AS value FROM graded GROUP BY ALL),
stats AS (
  SELECT user_id, avg_grade, updated, total_lines_of_code
  FROM (SELECT user_id, avg(value) AS avg_grade FROM graded GROUP BY ALL)
  JOIN (SELECT user_id, max(updated) AS updated,
      CAST(sum(lines_of_code) AS BIGINT) AS total_lines_of_code
    FROM repositories GROUP BY ALL) USING (user_id)),
ranks AS (
  SELECT row_number() OVER (ORDER BY avg_grade, updated, total_lines_of_code, user_id) AS rank,
    user_id, login, full_name, avg_grade, updated, total_lines_of_code
  FROM stats JOIN users USING (user_id)
  WHERE user_id IN (SELECT user_id FROM verified))"""
RANKED = f"WITH {TABLES}"


def day(column: str):
    return F.date_format(column, "yyyy-MM-dd")


def round6(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.round(column, 6))


def sums(d: Data) -> DataFrame:
    return r.category_sums(d.tables["repositories"], d.tables["grades"])


def verified(d: Data) -> DataFrame:
    return r.verified_technologies(
        d.tables["technologies_users"], d.tables["technologies_users_settings"],
        d.tables["developers"])


@query(f"""{RANKED} SELECT user_id, round(avg_grade, 6) AS avg_grade,
  strftime(updated, '%Y-%m-%d') AS updated, total_lines_of_code FROM stats""")
def user_grade_stats(d: Data) -> DataFrame:
    rows = r.user_stats(d.tables["repositories"], sums(d)).withColumn(
        "updated", day("updated_by_analyzer")).drop("updated_by_analyzer")
    return round6(rows, "avg_grade")


@query(f"{RANKED} SELECT user_id, category, round(value, 6) AS value FROM means")
def category_means(d: Data) -> DataFrame:
    return round6(r.category_means(sums(d)), "value")


@query(f"{RANKED} SELECT user_id, round(avg(value), 9) AS avg_grade FROM means GROUP BY ALL")
def user_avg_of_means(d: Data) -> DataFrame:
    means = r.category_means(sums(d))
    return r.avg_of_category_means(means).withColumn("avg_grade", F.round("avg_grade", 9))


@query(f"{RANKED} SELECT * FROM verified")
def verified_technologies(d: Data) -> DataFrame:
    return verified(d)


@query(f"""{RANKED} SELECT rank, user_id, login, full_name, round(avg_grade, 6) AS avg_grade,
  strftime(updated, '%Y-%m-%d') AS updated, total_lines_of_code FROM ranks""")
def users_ranks(d: Data) -> DataFrame:
    ranks = ranking.rank_users(d.tables)
    return round6(ranks.withColumn("updated", day("updated_by_analyzer")), "avg_grade").drop(
        "updated_by_analyzer")


@query(f"""{RANKED} SELECT row_number() OVER (ORDER BY user_id) AS rank, user_id, login FROM ranks""")
def users_ranks_by_id(d: Data) -> DataFrame:
    return ranking.rank_users(d.tables, "user_id").select("rank", "user_id", "login")


@query(f"{RANKED} SELECT rank, user_id, login, total_lines_of_code FROM ranks")
def refresh_ranks(d: Data) -> DataFrame:
    path = new_path(d.spark, "users_ranks")
    return ranking.refresh(ranking.rank_users(d.tables), path).select(
        "rank", "user_id", "login", "total_lines_of_code")


@query(f"""{RANKED}, lists AS (
  SELECT user_id, string_agg(DISTINCT language, ',' ORDER BY language) AS languages,
    string_agg(DISTINCT technology, ',' ORDER BY technology) AS technologies
  FROM verified GROUP BY user_id),
texts AS (
  SELECT user_id, string_agg(category || ' ' || CAST(round(value * 1000000) AS BIGINT), ','
    ORDER BY category) AS grades FROM means GROUP BY user_id)
SELECT rank, user_id, grades, languages, technologies
FROM ranks JOIN lists USING (user_id) JOIN texts USING (user_id)""")
def ranks_with_documents(d: Data) -> DataFrame:
    rows = ranking.with_documents(ranking.rank_users(d.tables), d.tables)
    grades = F.transform("grades", lambda g: F.concat(
        F.get_json_object(g, "$.category"), F.lit(" "),
        F.round(F.get_json_object(g, "$.value").cast("double") * 1000000).cast("long").cast("string")))
    return rows.select(
        "rank", "user_id", F.array_join(F.array_sort(grades), ",").alias("grades"),
        F.array_join("languages", ",").alias("languages"),
        F.array_join("technologies", ",").alias("technologies"))


@query(f"""{RANKED} SELECT user_id, string_agg(language, ' ' ORDER BY language) AS languages_text,
  string_agg(technology, ' ' ORDER BY technology) AS technologies_text
FROM verified GROUP BY user_id""")
def name_texts(d: Data) -> DataFrame:
    return r.name_texts(verified(d))


@query(f"""{RANKED} SELECT user_id, technology, position FROM (
  SELECT user_id, technology, row_number() OVER (PARTITION BY user_id ORDER BY technology) AS position
  FROM (SELECT DISTINCT user_id, technology FROM verified)) WHERE position <= 5""")
def top5_technologies(d: Data) -> DataFrame:
    return r.top_n_per_user(verified(d), 5)


@query("""SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_extendedprice, position FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey,
    l_linenumber, l_partkey, l_suppkey) AS position FROM lineitem)
WHERE position <= 1500""")
def top_n_of_large_groups(d: Data) -> DataFrame:
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"),
             F.col("l_partkey"), F.col("l_suppkey")]
    return ranked.top_n_per_group(d.table("lineitem"), ["l_returnflag"], order, 1500).select(
        "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "position")


@query(f"""{RANKED} SELECT user_id, login, full_name, round(avg_grade, 6) AS avg_grade,
  strftime(updated, '%Y-%m-%d') AS updated, total_lines_of_code
FROM stats JOIN users USING (user_id) WHERE user_id IN (SELECT user_id FROM developers)
ORDER BY stats.avg_grade DESC, stats.updated DESC, total_lines_of_code DESC, user_id LIMIT 20""")
def top_page(d: Data) -> DataFrame:
    rows = ranking.top_page(d.tables).withColumn("updated", day("updated_by_analyzer"))
    return round6(rows, "avg_grade").drop("updated_by_analyzer")


@query(f"""{RANKED}, contacts AS (
  SELECT 'Email' AS category, lower(c_name) || '@example.com' AS contact, c_custkey AS user_id
  FROM customer WHERE c_acctbal > 2000
  UNION ALL
  SELECT 'Website', 'http://site-' || c_nationkey || '-' || CAST(floor(c_acctbal / 1000) AS BIGINT)
    AS contact, min(c_custkey) FROM customer WHERE c_acctbal >= 0 GROUP BY contact)
SELECT u.user_id, u.login, u.full_name, d.job_seeker, d.description,
  coalesce(c.contacts, '') AS contacts, round(m.avg_grade, 6) AS avg_grade,
  strftime(a.updated, '%Y-%m-%d') AS updated, coalesce(t.technologies, 0) AS technologies,
  coalesce(t.languages, 0) AS languages, coalesce(g.grades, 0) AS grades
FROM users u JOIN developers d USING (user_id)
LEFT JOIN (SELECT user_id, string_agg(category || ':' || contact, ',' ORDER BY category) AS contacts
  FROM contacts GROUP BY user_id) c USING (user_id)
LEFT JOIN (SELECT user_id, avg(value) AS avg_grade FROM graded GROUP BY user_id) m USING (user_id)
LEFT JOIN (SELECT user_id, max(updated) AS updated FROM repositories GROUP BY user_id) a
  USING (user_id)
LEFT JOIN (SELECT user_id, count(DISTINCT technology) AS technologies,
  count(DISTINCT language) AS languages FROM settings GROUP BY user_id) t USING (user_id)
LEFT JOIN (SELECT user_id, count(*) AS grades FROM means GROUP BY user_id) g USING (user_id)""")
def user_page(d: Data) -> DataFrame:
    rows = ranking.user_pages(d.tables)
    contacts = F.transform("contacts", lambda c: F.concat_ws(
        ":", F.get_json_object(c, "$.category"), F.get_json_object(c, "$.contact")))
    return rows.select(
        "user_id", "login", "full_name", "job_seeker", "description",
        F.coalesce(F.array_join(contacts, ","), F.lit("")).alias("contacts"),
        F.round("avg_grade", 6).alias("avg_grade"), day("updated").alias("updated"),
        F.when(F.col("technologies").isNull(), 0).otherwise(F.size("technologies")).cast("long")
        .alias("technologies"),
        F.when(F.col("languages").isNull(), 0).otherwise(F.size("languages")).cast("long")
        .alias("languages"),
        F.when(F.col("grades").isNull(), 0).otherwise(F.size("grades")).cast("long")
        .alias("grades"))


@query(f"{RANKED} SELECT user_id, login, job_seeker FROM users JOIN developers USING (user_id)")
def users_developers(d: Data) -> DataFrame:
    return d.tables["users"].select("user_id", "login").join(
        d.tables["developers"].select("user_id", "job_seeker"), "user_id")


@query(f"""{RANKED} SELECT login, language, technology, round(avg(value), 2) AS grade, count(*) AS n
FROM settings s JOIN users USING (user_id) JOIN graded USING (user_id)
WHERE s.verified GROUP BY ALL""")
def multiway_check_join(d: Data) -> DataFrame:
    t = d.tables
    owners = t["repositories"].select("raw_id", "user_id")
    per_user = t["grades"].join(owners, "raw_id").groupBy("user_id").agg(
        F.sum("value").alias("total"), F.count("*").alias("n"))
    return (
        t["technologies_users_settings"].filter("verified")
        .join(t["users"].select("user_id", "login"), "user_id").join(per_user, "user_id")
        .select("login", "language", "technology",
                F.round(F.col("total") / F.col("n"), 2).alias("grade"), "n"))


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1""")
def single_row(d: Data) -> DataFrame:
    return d.table("orders").select("o_orderkey", "o_totalprice").orderBy(
        F.desc("o_totalprice"), "o_orderkey").limit(1)


@query("""SELECT o_orderkey, o_custkey, row_number() OVER (
  ORDER BY o_totalprice DESC, o_orderkey) AS number FROM orders""")
def global_row_numbers(d: Data) -> DataFrame:
    return ranked.global_row_number(
        d.table("orders").select("o_orderkey", "o_custkey", "o_totalprice"),
        [F.desc("o_totalprice"), F.col("o_orderkey")], "number"
    ).select("o_orderkey", "o_custkey", "number")


def standings_after_batches(d: Data) -> Standings:
    """The ranking of a third of the repositories, then the others in two batches."""
    part = F.pmod(F.xxhash64("raw_id"), F.lit(3))
    with small_broadcasts(d.spark):
        whole = {name: d.tables[name] for name in (
            "users", "developers", "technologies_users", "technologies_users_settings")}
        whole[ranking.VERIFIED] = ranking.with_verified(d.tables)[ranking.VERIFIED]  # no batch changes it
        whole |= {name: settle(d.tables[name].withColumn("_part", part), name)
                  for name in ("repositories", "grades")}

    def upto(n: int):
        return whole | {name: whole[name].filter(F.col("_part") <= n).drop("_part")
                        for name in ("repositories", "grades")}

    standings = Standings(d.spark, new_path(d.spark, "standings"), range_rows=100_000)
    standings.build(ranking.figures(upto(0)))
    for n in (1, 2):
        moved = whole["repositories"].filter(F.col("_part") == n).select("user_id")
        standings.merge(upto(n - 1), upto(n), moved)
    return standings


@query(f"""{RANKED} SELECT rank, user_id, login, round(avg_grade, 6) AS avg_grade,
  strftime(updated, '%Y-%m-%d') AS updated, total_lines_of_code FROM ranks""")
def standings_batches(d: Data) -> DataFrame:
    rows = standings_after_batches(d).rows()
    return round6(rows.withColumn("updated", day("updated_by_analyzer")), "avg_grade").select(
        "rank", "user_id", "login", "avg_grade", "updated", "total_lines_of_code")


@query(f"""{RANKED}, placed AS (
  SELECT rank, user_id, login, row_number() OVER (ORDER BY rank DESC) AS k, count(*) OVER () AS n FROM ranks)
SELECT page, rank, user_id, login FROM placed, (SELECT unnest([1, 2, 3, 7, 30]) AS page)
WHERE k > (page - 1) * 20 AND k <= page * 20""")
def standings_pages(d: Data) -> DataFrame:
    """Pages from the top and from the depth, each from the ranges that hold it."""
    standings = Standings(d.spark, new_path(d.spark, "standings"), range_rows=100_000)
    standings.build(ranking.figures(d.tables))
    pages = [standings.page(n).select(F.lit(n).alias("page"), "rank", "user_id", "login") for n in (1, 2, 3, 7, 30)]
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out
