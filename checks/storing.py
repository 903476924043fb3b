"""Merges into stored tables and lookups by key."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from skilltide.functions import ids
from skilltide.operators import grade as g, merge, ranked
from skilltide.plans import persisting
from skilltide.sources import tables as src
from skilltide.storage import settle

from .adapters import Data
from .extraction import PROFILES
from .grading import ALL_GRADES, FACTS, MESSAGES
from .registry import SQL, query

# The stored rows are the orders before 1999, the batch those since 1998 with changed prices.
STORED = """
stored AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
  WHERE o_orderdate < TIMESTAMP '1999-01-01'),
batch AS (
  SELECT o_orderkey, o_custkey + 1 AS o_custkey, o_orderstatus, o_totalprice * 2 AS o_totalprice
  FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')"""


def stored_and_batch(d: Data) -> tuple[DataFrame, DataFrame]:
    orders = d.table("orders")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    stored = orders.filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    batch = orders.filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return stored.select(*columns), batch.withColumns({
        "o_custkey": F.col("o_custkey") + 1, "o_totalprice": F.col("o_totalprice") * 2,
    }).select(*columns)


@query(f"""WITH {STORED}
SELECT * FROM stored
UNION ALL SELECT * FROM batch WHERE o_orderkey NOT IN (SELECT o_orderkey FROM stored)""")
def merge_insert_ignore(d: Data) -> DataFrame:
    return merge.insert_ignore(*stored_and_batch(d), ["o_orderkey"])


@query(f"""WITH {STORED}
SELECT coalesce(s.o_orderkey, b.o_orderkey) AS o_orderkey,
  coalesce(s.o_custkey, b.o_custkey) AS o_custkey,
  coalesce(s.o_orderstatus, b.o_orderstatus) AS o_orderstatus,
  coalesce(b.o_totalprice, s.o_totalprice) AS o_totalprice
FROM stored s FULL JOIN batch b ON s.o_orderkey = b.o_orderkey""")
def merge_upsert(d: Data) -> DataFrame:
    return merge.upsert(*stored_and_batch(d), ["o_orderkey"], ["o_totalprice"])


@query("""SELECT p_brand, p_name, bool_or(p_size > 45 OR p_retailprice > 1000 AND p_size < 3) AS flag
FROM part GROUP BY ALL""")
def merge_flag_or(d: Data) -> DataFrame:
    part = d.table("part")
    before = part.select("p_brand", "p_name", (F.col("p_size") > 45).alias("flag"))
    after = part.select("p_brand", "p_name", (
        (F.col("p_retailprice") > 1000) & (F.col("p_size") < 3)).alias("flag"))
    return merge.upsert_flag_or(before, after, ["p_brand", "p_name"], "flag")


@query("""WITH stored AS (
  SELECT p_name AS contact, min(p_partkey) AS owner FROM part WHERE p_size <= 5 GROUP BY p_name),
batch AS (SELECT p_name AS contact, max(p_partkey) AS owner FROM part GROUP BY p_name)
SELECT * FROM stored
UNION ALL SELECT * FROM batch WHERE contact NOT IN (SELECT contact FROM stored)""")
def merge_first_owner(d: Data) -> DataFrame:
    rows = d.table("part").select(F.col("p_name").alias("contact"), F.col("p_partkey").alias("owner"),
                                  "p_size")
    stored = rows.filter("p_size <= 5").groupBy("contact").agg(F.min("owner").alias("owner"))
    return merge.insert_first(stored, rows.drop("p_size"), ["contact"], [-F.col("owner")])


@query("""SELECT c_custkey, c_mktsegment FROM customer
WHERE NOT (c_mktsegment = 'BUILDING' AND c_acctbal < 3000)""")
def delete_rows(d: Data) -> DataFrame:
    return merge.delete_where(
        d.table("customer"), (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") < 3000)
    ).select("c_custkey", "c_mktsegment")


@query("""SELECT p_name AS key, CASE WHEN p_name = 'red bolt' THEN 'new' ELSE p_type END AS value
FROM part""")
def receiver_state(d: Data) -> DataFrame:
    state = d.table("part").select(F.col("p_name").alias("key"), F.col("p_type").alias("value"))
    return merge.set_state(state, "red bolt", "new")


@query("""SELECT c_custkey, CASE WHEN n_name IS NOT NULL THEN 'NATION_' || (c_nationkey + 3) END AS nation
FROM customer LEFT JOIN nation ON n_name = 'NATION_' || (c_nationkey + 3)""")
def fk_resolution(d: Data) -> DataFrame:
    rows = d.table("customer").select("c_custkey", F.concat(
        F.lit("NATION_"), (F.col("c_nationkey") + 3).cast("string")).alias("nation"))
    return merge.resolve_fk(rows, d.table("nation"), "nation", "n_name")


@query("""SELECT p_partkey, p_brand, p_size FROM part JOIN nation ON n_nationkey = p_size % 25
WHERE p_retailprice > 1000""")
def enabled_queries(d: Data) -> DataFrame:
    part = d.table("part").withColumns({
        "language_id": F.col("p_size") % 25, "enabled": F.col("p_retailprice") > 1000})
    nation = d.table("nation").select(F.col("n_nationkey").alias("id"),
                                      F.col("n_name").alias("language"))
    return src.search_list(part, nation).select("p_partkey", "p_brand", "p_size")


@query("""SELECT p_partkey, 'language:' || p_brand || ' in:' || p_name ||
  ' sort:updated mirror:false fork:false size:' || p_size || '..' || (p_size + 10) || ' stars:0..' ||
  p_size || ' ' || p_type AS text
FROM part""")
def search_query_text(d: Data) -> DataFrame:
    size = F.col("p_size")
    return d.table("part").select("p_partkey", ids.search_text(
        F.col("p_brand"), F.col("p_name"), size, size + 10, F.lit(0), size, F.col("p_type")
    ).alias("text"))


@query("""SELECT p_partkey, index FROM (
  SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS index,
    count(*) OVER () AS n FROM part)
WHERE index >= (700 + 1) % n""")
def resume_list(d: Data) -> DataFrame:
    return ranked.resume_from(
        d.table("part").select("p_name", "p_partkey"), [F.col("p_name"), F.col("p_partkey")], 700
    ).select("p_partkey", "index")


@query("""SELECT o_orderpriority, count(*) AS orders, CAST(max(o_custkey) AS BIGINT) AS last
FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL""")
def jdbc_like_query(d: Data) -> DataFrame:
    return src.read_query(d.spark, """
        SELECT o_orderpriority, count(*) AS orders, max(o_custkey) AS last
        FROM {orders} WHERE o_orderstatus = 'F' GROUP BY ALL""", {"orders": d.table("orders")})


# --- the whole batch ---

PERSIST = f"""{ALL_GRADES}, {PROFILES},
repos AS (SELECT DISTINCT repo_id AS raw_id, CAST(split_part(repo_id, '-', 1) AS BIGINT) AS user_id
  FROM grades),
techs AS (SELECT DISTINCT language, message AS technology, r.user_id
  FROM messages m JOIN repos r ON r.raw_id = m.repo_id WHERE message_type = 'dependence')"""


def stored_table(d: Data, name: str) -> DataFrame:
    """Stored rows the batch meets: rich customers, their contacts, technologies, first weeks."""
    rich = d.table("customer").filter("c_acctbal > 7000").select(F.col("c_custkey").alias("user_id"))
    first_weeks = d.batch.repositories.filter("raw_id LIKE '%-0'")
    technologies = d.table("nation").select(
        F.lit("JavaScript").alias("language"),
        F.concat(F.lit("lib-"), F.col("n_nationkey").cast("string")).alias("technology"),
        (F.col("n_nationkey") < 3).alias("synonym"))
    owned = technologies.withColumn("user_id", F.col("synonym").cast("long")).drop("synonym")
    if name == "languages":
        return d.table("nation").select(
            F.when(F.col("n_nationkey") == 0, "C++ 3").otherwise(F.col("n_name")).alias("language"))
    if name == "countries":
        return d.tables[name].filter("country = 'ASIA'")
    if name == "cities":
        return d.tables[name].filter("city = 'NATION_3'")
    if name == "users":
        return d.tables[name].join(rich, "user_id", "left_semi").withColumn("login", F.lit("old"))
    if name == "developers":
        return d.tables[name].join(rich, "user_id", "left_semi")
    if name == "contacts":
        return d.profile_users.join(rich, "user_id", "left_semi").select(
            F.lit("Email").alias("category"), F.col("email").alias("contact"),
            F.lit(-1).cast("long").alias("user_id"))
    if name == "technologies":
        return technologies
    if name == "technologies_users":
        return owned
    if name == "technologies_users_settings":
        return owned.withColumn("verified", F.lit(False))
    if name == "repositories":
        return first_weeks.select(
            "raw_id", "user_id", F.lit("old").alias("name"),
            F.lit(-1).cast("long").alias("lines_of_code"),
            F.lit("2020-01-01").cast("timestamp_ntz").alias("updated_by_analyzer"))
    return first_weeks.select(
        F.lit("Robust").alias("category"), "raw_id", F.lit(9.0).alias("value"))


def persisted(d: Data, name: str) -> DataFrame:
    """One table after the batch, as ``persist`` makes it."""
    rows = persisting.ROWS[name](d.batch, F.lit("2024-02-01 00:00:00"))
    return persisting.merge_table(name, stored_table(d, name), rows)


@query(f"""WITH {FACTS}
SELECT n_name AS language FROM nation WHERE n_nationkey <> 0 UNION SELECT 'C++ 3' FROM nation WHERE n_nationkey = 0
UNION SELECT language || ' ' || (k // 10) FROM facts WHERE k IS NOT NULL
UNION SELECT min(language) FROM facts GROUP BY repo_id""")
def persist_languages(d: Data) -> DataFrame:
    return persisted(d, "languages")


@query("SELECT r_name AS place FROM region UNION ALL SELECT n_name FROM nation "
       "WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal >= 0)")
def persist_places(d: Data) -> DataFrame:
    return persisted(d, "countries").select(F.col("country").alias("place")).unionByName(
        persisted(d, "cities").select(F.col("city").alias("place")))


@query(f"WITH {PROFILES} SELECT owner_id AS user_id, owner_login AS login, "
       "coalesce(full_name, '') AS full_name FROM profiles")
def persist_users(d: Data) -> DataFrame:
    return persisted(d, "users").select("user_id", "login", "full_name")


@query(f"""WITH {PROFILES}
SELECT owner_id AS user_id, n_name AS city, r_name AS country,
  CASE WHEN old THEN c_acctbal > 0 ELSE coalesce(job_seeker, false) END AS job_seeker,
  CASE WHEN old THEN c_mktsegment ELSE coalesce(description, '') END AS description,
  CASE WHEN old THEN n_name || ', ' || r_name ELSE coalesce(location, '') END AS raw_location
FROM (
  SELECT p.*, c.*, c.c_acctbal > 7000 AND c_mktsegment <> 'MACHINERY' AS old,
    CASE WHEN c_acctbal >= 0 THEN n.n_name END AS n_name,
    CASE WHEN c_acctbal >= 0 THEN r.r_name END AS r_name
  FROM profiles p JOIN customer c ON c.c_custkey = p.owner_id
  JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey)""")
def persist_developers(d: Data) -> DataFrame:
    return persisted(d, "developers").select(
        "user_id", "job_seeker", "description", "raw_location", "country", "city")


@query(f"""WITH {PROFILES}
SELECT 'Email' AS category, email AS contact,
  CASE WHEN c_acctbal > 7000 THEN -1 ELSE owner_id END AS user_id
FROM profiles JOIN customer ON c_custkey = owner_id WHERE email IS NOT NULL
UNION ALL SELECT 'Website', blog, min(owner_id) FROM profiles WHERE blog IS NOT NULL GROUP BY blog""")
def persist_contacts(d: Data) -> DataFrame:
    return persisted(d, "contacts")


@query(f"""{PERSIST},
names AS (SELECT DISTINCT language, technology FROM techs),
flags AS (
  SELECT language, technology, language = 'JavaScript' AND EXISTS (
    SELECT 1 FROM names x WHERE x.language = n.language AND x.technology <> n.technology
      AND contains(n.technology, x.technology)) AS synonym
  FROM names n
  UNION ALL SELECT 'JavaScript', 'lib-' || n_nationkey, n_nationkey < 3 FROM nation)
SELECT language, technology, bool_or(synonym) AS synonym FROM flags GROUP BY ALL""")
def persist_technologies(d: Data) -> DataFrame:
    return persisted(d, "technologies")


@query(f"""{PERSIST}
SELECT DISTINCT * FROM (
  SELECT language, technology, user_id FROM techs
  UNION ALL SELECT 'JavaScript', 'lib-' || n_nationkey, CAST(n_nationkey < 3 AS BIGINT) FROM nation)""")
def persist_technologies_users(d: Data) -> DataFrame:
    return persisted(d, "technologies_users")


@query(f"""{PERSIST}
SELECT language, technology, user_id, bool_or(verified) AS verified FROM (
  SELECT language, technology, user_id, true AS verified FROM techs
  UNION ALL SELECT 'JavaScript', 'lib-' || n_nationkey, CAST(n_nationkey < 3 AS BIGINT), false
  FROM nation)
GROUP BY ALL""")
def persist_settings(d: Data) -> DataFrame:
    return persisted(d, "technologies_users_settings")


@query(f"""{PERSIST}
SELECT r.raw_id, r.user_id, max(lines_of_code) AS lines_of_code,
  CASE WHEN r.raw_id LIKE '%-0' THEN 'old' ELSE max(g.name) END AS name,
  '2024-02-01 00:00:00' AS updated
FROM repos r JOIN grades g ON g.repo_id = r.raw_id GROUP BY r.raw_id, r.user_id""")
def persist_repositories(d: Data) -> DataFrame:
    rows = persisted(d, "repositories")
    return rows.withColumn("updated", F.date_format("updated_by_analyzer", "yyyy-MM-dd HH:mm:ss")
                           ).drop("updated_by_analyzer")


@query(f"{PERSIST} SELECT grade_category AS category, repo_id AS raw_id, value FROM grades")
def persist_grades(d: Data) -> DataFrame:
    return persisted(d, "grades").withColumn("value", F.round("value", 6))


@query(f"""WITH {MESSAGES}, maps AS (
  SELECT DISTINCT repo_id, split_part(repo_id, '-', 1) AS owner, language, message FROM messages
  WHERE message_type = 'dependence')
SELECT owner, language AS key, string_agg(message, ',' ORDER BY message) AS values
FROM maps GROUP BY owner, language""")
def merge_map_of_lists(d: Data) -> DataFrame:
    maps = g.technology_maps(g.dependencies_of(d.messages)).withColumn(
        "owner", F.substring_index("repo_id", "-", 1))
    merged = g.collect_map(g.merge_maps(maps, ["owner"], "language_to_technologies"), ["owner"])
    return merged.select("owner", "key", F.array_join("values", ",").alias("values"))


@query(f"""{PERSIST}
SELECT DISTINCT t.user_id, t.language, t.technology FROM techs t""")
def graded_by_user(d: Data) -> DataFrame:
    batch = d.batch
    return batch.technologies.join(
        batch.repositories.select("raw_id", "user_id"), "raw_id"
    ).select("user_id", "language", "technology").distinct()


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'""")
def settled_table(d: Data) -> DataFrame:
    return settle(d.table("orders").filter("o_orderstatus = 'F'").select(
        "o_orderkey", "o_totalprice"), "orders")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def table_scan(d: Data) -> DataFrame:
    return src.read_table(d.spark, "orders.parquet", d.folder).filter(
        (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 1000)
    ).select("o_orderkey", "o_custkey", "o_totalprice")


# the queries above that show the rows of one table after the batch, or of two
SHOWN = {"languages": "persist_languages", "countries": "persist_places", "cities": "persist_places",
         "users": "persist_users", "developers": "persist_developers", "contacts": "persist_contacts",
         "technologies": "persist_technologies", "technologies_users": "persist_technologies_users",
         "technologies_users_settings": "persist_settings", "repositories": "persist_repositories",
         "grades": "persist_grades"}


@query(" UNION ALL ".join(
    f"SELECT '{' and '.join(t for t in SHOWN if SHOWN[t] == name)}' AS tables, count(*) AS n_rows FROM ({SQL[name]})"
    for name in dict.fromkeys(SHOWN.values())))
def persist_all_tables(d: Data) -> DataFrame:
    """All tables after one batch, from a single call."""
    stored = {name: stored_table(d, name) for name in SHOWN}
    after = persisting.persist(d.batch, stored, F.lit("2024-02-01 00:00:00"))
    groups = [[t for t in SHOWN if SHOWN[t] == name] for name in dict.fromkeys(SHOWN.values())]
    counts = [after[t].agg(F.count("*").alias("n")).select(F.lit(" and ".join(g)).alias("tables"), "n")
              for g in groups for t in g]
    return reduce(DataFrame.unionByName, counts).groupBy("tables").agg(F.sum("n").alias("n_rows"))
