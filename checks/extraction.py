"""Search pages, candidates, profiles and commit shares."""

from pyspark.sql import DataFrame, functions as F

from skilltide.functions import ids, numbers
from skilltide.operators import extract as ex
from skilltide.plans.candidates import enrich_users as enrich, extract_candidates as extract
from skilltide.sources import pages as pg

from .adapters import AS_OF, RULES, Data
from .registry import query

REPOS = """
repos AS (
  SELECT o_orderkey, c_custkey AS owner_id, lower(c_name) AS owner_login,
    base64(encode('010:Repository' || o_orderkey)) AS repo_id, 'repo-' || o_orderkey AS name,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'JavaScript' WHEN '2' THEN 'Python'
      WHEN '3' THEN 'Perl' WHEN '5' THEN 'C++' END AS primary_language,
    c_mktsegment <> 'MACHINERY' AS is_user, o_orderstatus, o_totalprice,
    CAST(floor(o_totalprice / 2500) AS BIGINT) AS span, o_totalprice >= 8000 AS answered
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
# a found repository is an open order; the same row is owned unless it is a fork
CANDIDATES = REPOS + """,
filtered AS (
  SELECT * FROM repos
  WHERE answered AND is_user AND span >= 60 AND primary_language IN ('JavaScript', 'Python', 'C++')
    AND (o_orderstatus = 'O' OR o_orderstatus <> 'P')),
recent AS (
  SELECT l_orderkey FROM lineitem GROUP BY l_orderkey
  HAVING datediff('day', CAST(max(l_shipdate) AS DATE), DATE '2001-06-01') < 365),
fresh AS (SELECT * FROM filtered WHERE o_orderkey NOT IN (SELECT l_orderkey FROM recent)),
candidates AS (
  SELECT * FROM fresh WHERE owner_id IN (
    SELECT owner_id FROM fresh GROUP BY owner_id HAVING count(*) >= 2))"""
FLAT = """owner_id, owner_login, repo_id, name, primary_language,
  'HTML,' || primary_language AS languages, 'master' AS default_branch"""
RATIOS = """
ratios AS (
  SELECT l_orderkey, sum(CASE WHEN l_returnflag <> 'R' THEN floor(l_quantity) ELSE 0 END)
    / sum(floor(l_quantity)) AS owner_ratio
  FROM lineitem GROUP BY l_orderkey)"""
ENRICHED = CANDIDATES + "," + RATIOS + """,
rated AS (
  SELECT c.*, r.owner_ratio FROM candidates c JOIN ratios r ON r.l_orderkey = c.o_orderkey
  WHERE r.owner_ratio >= 0.4),
kept AS (
  SELECT * FROM rated WHERE owner_id IN (
    SELECT owner_id FROM rated GROUP BY owner_id HAVING count(*) >= 2))"""
PROFILES = """
profiles AS (
  SELECT c_custkey AS owner_id, lower(c_name) AS owner_login,
    CASE WHEN c_acctbal >= 0 THEN c_name END AS full_name,
    CASE WHEN c_acctbal > 5000 THEN c_mktsegment END AS description,
    CASE WHEN c_acctbal >= 0 THEN n_name || ', ' || r_name END AS location,
    CAST(NULL AS VARCHAR) AS company,
    CASE WHEN c_acctbal > 2000 THEN lower(c_name) || '@example.com' END AS email,
    CASE WHEN c_acctbal >= 0 THEN
      'http://site-' || c_nationkey || '-' || CAST(floor(c_acctbal / 1000) AS BIGINT) END AS blog,
    CASE WHEN c_acctbal > 1000 THEN c_acctbal > 4000 END AS job_seeker
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def flat(df: DataFrame) -> DataFrame:
    return df.withColumn("languages", F.array_join("languages", ","))


def nodes(d: Data) -> DataFrame:
    return pg.parse_pages(d.pages)


@query("""SELECT CASE WHEN o_totalprice < 5000 THEN 'error' WHEN o_totalprice < 8000 THEN 'failure'
  ELSE 'result' END AS route,
  CASE WHEN o_totalprice >= 8000 AND left(o_orderpriority, 1) <> '5'
    THEN CAST(o_orderkey AS VARCHAR) END AS cursor,
  CASE WHEN o_totalprice < 5000 THEN 'failed ' || o_orderkey END AS error
FROM orders JOIN customer ON o_custkey = c_custkey""")
def page_router_cursor(d: Data) -> DataFrame:
    routed = pg.route_pages(d.responses)
    none = F.lit(None).cast("string")
    results = routed.results.select(
        F.lit("result").alias("route"),
        pg.next_cursor(pg.page_struct(F.col("value"))).alias("cursor"), none.alias("error"))
    errors = routed.errors.select(
        F.lit("error").alias("route"), none.alias("cursor"),
        F.get_json_object("value", "$[0].message").alias("error"))
    failures = routed.failures.select(
        F.lit("failure").alias("route"), none.alias("cursor"), none.alias("error"))
    return results.unionByName(errors).unionByName(failures)


@query(f"""WITH {REPOS}
SELECT repo_id, name, owner_login,
  CASE WHEN o_orderstatus = 'O' THEN primary_language END AS primary_language, 'found' AS source
FROM repos WHERE answered
UNION ALL
SELECT repo_id, name, owner_login, primary_language, 'pinned' FROM repos
WHERE answered AND o_orderstatus <> 'P' AND o_totalprice > 250000
UNION ALL
SELECT repo_id, name, owner_login, primary_language, 'owned' FROM repos
WHERE answered AND o_orderstatus <> 'P'""")
def explode_nested_repos(d: Data) -> DataFrame:
    rows = nodes(d)
    columns = ["repo_id", "name", "owner_login", "primary_language"]
    return (
        ex.found_repositories(rows).select(*columns, F.lit("found").alias("source"))
        .unionByName(ex.owner_repositories(rows, "pinnedRepositories")
                     .select(*columns, F.lit("pinned").alias("source")))
        .unionByName(ex.owner_repositories(rows, "repositories")
                     .select(*columns, F.lit("owned").alias("source"))))


@query(f"""WITH {REPOS}
SELECT repo_id, count(*) AS times FROM (
  SELECT repo_id FROM repos WHERE answered
  UNION ALL SELECT repo_id FROM repos
  WHERE answered AND o_orderstatus <> 'P' AND o_totalprice > 250000
  UNION ALL SELECT repo_id FROM repos WHERE answered AND o_orderstatus <> 'P')
GROUP BY repo_id""")
def all_repositories_once(d: Data) -> DataFrame:
    return ex.all_repositories(nodes(d)).groupBy("repo_id").agg(F.count("*").alias("times"))


@query("""SELECT c_custkey,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 'Unknown'
    WHEN c_mktsegment = 'MACHINERY' THEN 'Organization' ELSE 'User' END AS user_type,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN -1 ELSE c_custkey END AS id
FROM customer""")
def decode_owner_ids(d: Data) -> DataFrame:
    from .adapters import b64
    key = F.col("c_custkey").cast("string")
    segment = F.col("c_mktsegment")
    encoded = (
        F.when(segment == "FURNITURE", F.concat(F.lit("no base64! "), key))
        .when(segment == "MACHINERY", b64(F.concat(F.lit("012:Organization"), key)))
        .otherwise(b64(F.concat(F.lit("04:User"), key))))
    return d.table("customer").select(
        "c_custkey", ids.decode_owner_id(encoded).alias("x")).select("c_custkey", "x.*")


@query(f"""WITH {REPOS}
SELECT repo_id, name, owner_id FROM repos
WHERE answered AND is_user AND span >= 60 AND primary_language IN ('JavaScript', 'Python', 'C++')
  AND o_orderstatus = 'O'""")
def candidate_filters(d: Data) -> DataFrame:
    found = ex.found_repositories(nodes(d))
    return ex.filter_candidates(found, RULES.min_age_days, RULES.languages).select(
        "repo_id", "name", "owner_id")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS repo_id FROM orders
WHERE o_orderkey NOT IN (
  SELECT l_orderkey FROM lineitem GROUP BY l_orderkey
  HAVING datediff('day', CAST(max(l_shipdate) AS DATE), DATE '2001-06-01') < 365)""")
def not_recently_analysed(d: Data) -> DataFrame:
    repos = d.table("orders").select(F.col("o_orderkey").cast("string").alias("repo_id"))
    analysed = d.table("lineitem").groupBy(
        F.col("l_orderkey").cast("string").alias("raw_id")
    ).agg(F.max("l_shipdate").alias("updated_by_analyzer"))
    return ex.drop_recent(repos, analysed, F.lit(AS_OF).cast("date"), 365)


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (
  SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 12)""")
def min_group_size(d: Data) -> DataFrame:
    return ex.with_min_group(
        d.table("orders").select("o_orderkey", "o_custkey"), 12, ["o_custkey"])


@query(f"WITH {CANDIDATES} SELECT {FLAT} FROM candidates")
def extract_candidates(d: Data) -> DataFrame:
    return flat(extract(d.pages, d.analysed, RULES, F.lit(AS_OF).cast("date")))


@query(f"""WITH {ENRICHED}
SELECT {FLAT}, round(owner_ratio, 6) AS owner_ratio,
  'https://github.com/' || owner_login || '/' || name || '/archive/master.tar.gz' AS archive_url
FROM kept""")
def enrich_repositories(d: Data) -> DataFrame:
    repos = extract(d.pages, d.analysed, RULES, F.lit(AS_OF).cast("date"))
    rows = enrich(repos, d.profiles, d.weeks, RULES).repositories
    return flat(rows).withColumn("owner_ratio", F.round("owner_ratio", 6))


@query(f"""WITH {ENRICHED}, {PROFILES}
SELECT * FROM profiles WHERE owner_id IN (SELECT owner_id FROM kept)""")
def enrich_users(d: Data) -> DataFrame:
    repos = extract(d.pages, d.analysed, RULES, F.lit(AS_OF).cast("date"))
    return enrich(repos, d.profiles, d.weeks, RULES).users


@query("""SELECT lower(c_name) AS owner_login, 'repo-' || l_orderkey AS name,
  round(sum(CASE WHEN l_returnflag <> 'R' THEN floor(l_quantity) ELSE 0 END)
    / sum(floor(l_quantity)), 6) AS owner_ratio
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
GROUP BY ALL""")
def owner_commit_ratio(d: Data) -> DataFrame:
    return ex.commit_ratios(d.weeks).withColumn("owner_ratio", F.round("owner_ratio", 6))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_linestatus = 'O' THEN 0.0 ELSE round((l_linenumber - 1) / nullif(
    l_linenumber - 1 + floor(l_quantity) - 1, 0), 6) END AS ratio
FROM lineitem""")
def commit_ratio_arrays(d: Data) -> DataFrame:
    mine = F.array((F.col("l_linenumber") - 1).cast("long"), F.lit(None).cast("long"))
    everyone = F.array((F.col("l_linenumber") - 1).cast("long"),
                       F.floor("l_quantity").cast("long") - 1)
    owner = F.when(F.col("l_linestatus") != "O", mine)
    return d.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(numbers.commit_ratio(owner, everyone), 6).alias("ratio"))


@query(f"WITH {PROFILES} SELECT owner_id, description, company, email FROM profiles")
def profile_nulls(d: Data) -> DataFrame:
    return ex.attach_profiles(d.owners, d.profiles).select(
        "owner_id", "description", "company", "email")


@query(f"WITH {PROFILES} SELECT owner_id, owner_login, full_name, blog, job_seeker FROM profiles")
def profile_sanity(d: Data) -> DataFrame:
    return ex.attach_profiles(d.owners, d.profiles).select(
        "owner_id", "owner_login", "full_name", "blog", "job_seeker")


@query("""SELECT c_custkey, 'https://github.com/' || lower(c_name) || '/' || n_name || '/archive/' ||
  c_mktsegment || '.tar.gz' AS url
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def archive_urls(d: Data) -> DataFrame:
    return d.table("customer").join(
        d.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", ids.archive_url(
        F.lower("c_name"), F.col("n_name"), F.col("c_mktsegment")).alias("url"))


@query(f"""WITH {PROFILES}
SELECT 'Email' AS category, email AS contact, owner_id AS user_id FROM profiles
WHERE email IS NOT NULL
UNION ALL SELECT 'Website', blog, owner_id FROM profiles WHERE blog IS NOT NULL""")
def contacts_long(d: Data) -> DataFrame:
    return d.contact_rows


@query("SELECT DISTINCT unnest([p_type, p_brand, 'any']) AS language FROM part")
def user_languages(d: Data) -> DataFrame:
    return ex.languages_of(d.table("part").select(
        F.array("p_type", F.lit("any")).alias("languages"),
        F.col("p_brand").alias("primary_language")))


@query(f"""WITH {CANDIDATES}
SELECT owner_id, owner_login, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names
FROM candidates GROUP BY ALL""")
def grouped_users(d: Data) -> DataFrame:
    users = ex.group_users(extract(d.pages, d.analysed, RULES, F.lit(AS_OF).cast("date")))
    return users.select(
        "owner_id", "owner_login", F.size("repositories").cast("long").alias("n"),
        F.array_join(F.array_sort("repositories.name"), ",").alias("names"))
