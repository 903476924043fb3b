"""Findings from repository files, manifests and linter reports."""

from pyspark.sql import DataFrame, functions as F

from skilltide.operators import files as f, manifests as m
from skilltide.plans.analysing import analyze_files as analyse
from skilltide.sources import files as sf, lint
from skilltide.storage import settle

from .adapters import COMMENT_MARKS, Data
from .registry import query

CONTENT = r"regexp_replace(text, '(^|\n)([A-Za-z]+) ', '\1#include <\2.h> ', 'g')"
for _plain, _marked in COMMENT_MARKS:
    CONTENT = f"replace({CONTENT}, '{_plain}', '{_marked}')"
CODE = r"""regexp_replace(content, '(\\[\s\S]|"(?:\\[\s\S]|[^"\\\r\n])*"|''(?:\\[\s\S]|[^''\\\r\n])*'''
    || '|`(?:\\[\s\S]|[^`\\])*`)|//[^\r\n]*|/\*(?s:.*?)(?:\*/|\z)', '\1', 'g')"""
FILES = f"""
files AS (SELECT *, {CODE} AS code FROM (
  SELECT doc_id, source || '-' || lang AS repo_id, 'project-' || source AS repo_name, lang,
    CASE lang WHEN 'en' THEN CASE WHEN n_chars < 500 THEN './tests/t' || doc_id || '.js'
        ELSE './src/f' || doc_id || '.js' END
      WHEN 'fr' THEN './lib/f' || doc_id || '.cpp' WHEN 'de' THEN './src/f' || doc_id || '.c'
      ELSE './docs/README' || doc_id || '.md' END AS path,
    CASE lang WHEN 'en' THEN 'JavaScript' WHEN 'fr' THEN 'C++' WHEN 'de' THEN 'C' END AS language,
    n_chars AS size,
    {CONTENT} AS content
  FROM documents))"""
INCLUDES = FILES + """,
includes AS (
  SELECT DISTINCT repo_id, repo_name, language, regexp_extract(line, '#include <([a-zA-Z0-9/._-]*)>', 1) AS header
  FROM (SELECT *, unnest(string_split_regex(code, '\\n|\\r')) AS line FROM files
    WHERE language IN ('C', 'C++'))
  WHERE regexp_matches(line, '#include <[a-zA-Z0-9/._-]*>'))"""
LINES = """
lines AS (
  SELECT repo_id, repo_name, language, CAST(sum(len(list_filter(string_split_regex(code, '\\n|\\r'),
    lambda l: NOT regexp_matches(l, '^\\s*$')))) AS BIGINT) AS lines_of_code
  FROM files WHERE language IS NOT NULL GROUP BY ALL)"""

# Badges that occur in the page texts.
BADGES = {'class="ad"': "advert", "track(": "tracker", "<nav>": "navigation", "<nope>": "nothing"}
HEADERS = [("C", "Das.h", "LibDas"), ("C", "Und.h", "LibUnd"), ("C++", "Le.h", "LibLe"),
           ("C++", "Un.h", "LibUn")]
PREFIXES = [("C++", "La", "LibLa"), ("C", "Ei", "LibEi"), ("C", "D", "LibDas")]


@query(f"WITH {FILES}, {LINES} SELECT * FROM lines")
def lines_of_code(d: Data) -> DataFrame:
    return f.lines_of_code(f.file_facts(d.files))


@query(f"WITH {FILES} SELECT repo_id, repo_name, bool_or(path LIKE '%/tests/%') AS tests_dir_exists "
       "FROM files GROUP BY ALL")
def tests_dir(d: Data) -> DataFrame:
    return f.tests_dir(d.files)


@query(f"WITH {INCLUDES} SELECT * FROM includes")
def include_extract(d: Data) -> DataFrame:
    return f.includes(f.file_facts(d.files))


@query(f"""WITH {INCLUDES}
SELECT DISTINCT repo_id, repo_name, i.language, h.library FROM includes i
JOIN (VALUES {', '.join(str(h) for h in HEADERS)}) h(language, header, library)
  ON h.language = i.language AND h.header = i.header
UNION
SELECT repo_id, repo_name, i.language, h.library FROM includes i
JOIN (VALUES {', '.join(str(h) for h in PREFIXES)}) h(language, prefix, library)
  ON h.language = i.language AND starts_with(i.header, h.prefix)""")
def header_library(d: Data) -> DataFrame:
    exact = d.values(HEADERS, "language string, header string, library string")
    return f.header_libraries(f.includes(f.file_facts(d.files)), exact, PREFIXES)


@query("""SELECT DISTINCT regexp_extract(url, '://([^/]+)', 1) AS repo_id, 'site' AS repo_name, tool
FROM (SELECT url, unnest(list_filter([
  CASE WHEN contains(html, 'class="ad"') THEN 'advert' END,
  CASE WHEN contains(html, 'track(') THEN 'tracker' END,
  CASE WHEN contains(html, '<nav>') THEN 'navigation' END,
  CASE WHEN contains(html, '<nope>') THEN 'nothing' END], lambda x: x IS NOT NULL)) AS tool FROM pages)""")
def badge_scan(d: Data) -> DataFrame:
    pages = d.table("pages").select(
        F.regexp_extract("url", "://([^/]+)", 1).alias("repo_id"), F.lit("site").alias("repo_name"),
        F.concat(F.lit("./p"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"),
        F.lit("").alias("login"), F.length("html").alias("size"), F.col("html").alias("content"))
    return f.tools_by_badge(f.file_facts(pages, BADGES))


@query("""SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS repo_id, 'r' AS repo_name,
  CASE o_orderstatus WHEN 'F' THEN 'docker' ELSE 'travis' END AS tool
FROM orders WHERE o_orderstatus IN ('F', 'O') AND floor(o_totalprice / 10000) > 10""")
def tool_by_filename(d: Data) -> DataFrame:
    status = F.col("o_orderstatus")
    name = F.when(status == "F", "Dockerfile").when(status == "O", ".travis.yml").otherwise("x.yml")
    return f.tools_by_filename(d.table("orders").select(
        F.col("o_custkey").cast("string").alias("repo_id"), F.lit("r").alias("repo_name"),
        F.concat(F.lit("./a/"), name).alias("path"),
        F.floor(F.col("o_totalprice") / 10000).alias("size")))


# a part is a file: names have a blank, which is no valid path, unless it is replaced
PARTS = """
parts AS (
  SELECT p_brand AS repo_id, p_partkey,
    p_retailprice > 2080 OR p_size = 50 AND p_type = 'PROMO' AS bad FROM part)"""


def part_files(d: Data) -> DataFrame:
    unusual, compiled = F.col("p_retailprice") > 2080, (F.col("p_size") == 50) & (
        F.col("p_type") == "PROMO")
    name = F.when(unusual, F.col("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))
    return d.table("part").select(
        F.col("p_brand").alias("repo_id"), "p_partkey",
        F.concat(F.lit("./src/"), name, F.when(compiled, ".DLL").otherwise(".c")).alias("path"))


@query(f"WITH {PARTS} SELECT repo_id, p_partkey FROM parts "
       "WHERE repo_id NOT IN (SELECT repo_id FROM parts WHERE bad)")
def path_veto(d: Data) -> DataFrame:
    return f.veto_invalid(part_files(d)).select("repo_id", "p_partkey")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS repo_id, o_orderkey FROM orders
WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)""")
def binary_veto(d: Data) -> DataFrame:
    price = F.col("o_totalprice")
    path = F.when(price > 495000, "./lib/x.SO").when(price > 490000, "./node_modules/a.js").otherwise(
        "./src/node_modules.js")
    rows = d.table("orders").select(
        F.col("o_custkey").cast("string").alias("repo_id"), "o_orderkey", path.alias("path"))
    return f.veto_binaries(rows).select("repo_id", "o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_type IN ('SMALL', 'LARGE')")
def source_cleanup(d: Data) -> DataFrame:
    names = {"STANDARD": ".eslintrc.js", "ECONOMY": "app.min.js", "MEDIUM": "yarn.lock",
             "PROMO": "package-lock.json", "SMALL": "app.js", "LARGE": "min.js"}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    rows = d.table("part").withColumn("path", F.concat(F.lit("./a/"), table[F.col("p_type")]))
    return f.clean_sources(rows).select("p_partkey")


@query(f"""WITH {FILES} SELECT repo_id, path FROM files
WHERE repo_id IN (SELECT repo_id FROM files GROUP BY repo_id HAVING sum(size) <= 60000)""")
def repo_size_cap(d: Data) -> DataFrame:
    return sf.cap_repo_size(d.files, 60000).select("repo_id", "path")


@query("""SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS repo_id,
  CASE WHEN o_orderstatus = 'P' THEN 'javascript' ELSE 'cpp' END AS analyzer
FROM orders WHERE o_orderpriority <> '5-LOW'""")
def analyzer_dispatch(d: Data) -> DataFrame:
    language = F.when(F.col("o_orderpriority") == "5-LOW", "Ada").when(
        F.col("o_orderstatus") == "P", "JavaScript").when(
        F.col("o_orderstatus") == "F", "C").otherwise("C++")
    return f.dispatch(d.table("orders").select(
        F.col("o_custkey").cast("string").alias("repo_id"),
        F.array(language, F.lit("HTML")).alias("languages")))


# --- linter reports ---

@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'C' ELSE 'C++' END AS language,
  'src/f' || user_id || CASE WHEN event_type = 'click' THEN '.c' ELSE '.cpp' END AS file,
  'rule' || user_id AS rule
FROM events WHERE event_type IN ('click', 'view') AND value >= 1""")
def lint_rows(d: Data) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    file = F.concat(F.lit("src/f"), user, F.when(kind == "click", ".c").otherwise(".cpp"))
    rule = F.when(F.col("value") < 1, "").otherwise(F.concat(F.lit("rule"), user))
    head = F.when(kind.isin("click", "view"), "WARN").when(kind == "error", "Checking").otherwise("x")
    return lint.lint_rows(d.table("events").select(
        "event_id", F.concat_ws(";", head, file, rule).alias("value")))


@query("""SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'null' ELSE l_returnflag END AS rule
FROM lineitem
UNION ALL SELECT l_orderkey, l_linestatus FROM lineitem""")
def lint_json_flatten(d: Data) -> DataFrame:
    rule = F.when(F.col("l_returnflag") != "R", F.col("l_returnflag"))
    report = F.to_json(F.array(
        F.struct(F.lit("a.js").alias("filePath"), F.array(
            F.struct(rule.alias("ruleId")), F.struct(F.col("l_linestatus").alias("ruleId")),
        ).alias("messages")),
        F.struct(F.lit("b.js").alias("filePath"),
                 F.array().cast("array<struct<ruleId:string>>").alias("messages"))))
    return lint.lint_json(d.table("lineitem").select("l_orderkey", report.alias("value")))


# --- manifests ---

PACKAGES = """
packages AS (
  SELECT l_orderkey || '-' || rn AS repo_id, 'repo-' || repo_id AS repo_name,
    l_partkey, l_suppkey, l_returnflag AS flag, l_tax,
    CASE l_linenumber WHEN 1 THEN '.' WHEN 2 THEN './app' ELSE './vendor/p' || l_linenumber END AS dir,
    dir || '/' || CASE WHEN l_quantity >= 40 THEN 'index.js' WHEN l_linestatus = 'F'
      THEN 'package.json' ELSE 'bower.json' END AS path,
    l_quantity < 40 AS is_manifest
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey,
    l_suppkey, l_quantity, l_extendedprice, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem)),
manifests AS (SELECT * FROM packages WHERE is_manifest),
tops AS (
  SELECT repo_id, dir FROM (SELECT *, row_number() OVER (
    PARTITION BY repo_id ORDER BY length(path), path) AS n FROM manifests) WHERE n = 1)"""


def own_manifests(d: Data) -> DataFrame:
    return m.manifests(f.file_facts(d.package_files))


@query(f"""WITH {PACKAGES}
SELECT repo_id, repo_name, 'part-' || l_partkey AS dependency FROM manifests
UNION ALL SELECT repo_id, repo_name, 'supp-' || l_suppkey FROM manifests WHERE flag <> 'R'""")
def manifest_dependencies(d: Data) -> DataFrame:
    return m.manifest_dependencies(own_manifests(d))


@query(f"""WITH {PACKAGES}
SELECT DISTINCT repo_id, repo_name FROM manifests
WHERE l_tax > 0.05 OR repo_id IN (SELECT repo_id FROM packages WHERE NOT is_manifest AND flag = 'R')""")
def node_dependence(d: Data) -> DataFrame:
    return m.uses_node(own_manifests(d), f.node_repositories(f.file_facts(d.package_files)))


@query(f"""WITH {PACKAGES}, stated AS (
  SELECT repo_id, flag, row_number() OVER (PARTITION BY repo_id ORDER BY length(path), path) AS n
  FROM manifests WHERE flag <> 'R')
SELECT DISTINCT repo_id FROM manifests
WHERE repo_id NOT IN (SELECT repo_id FROM stated WHERE n = 1 AND flag = 'N')""")
def manifest_origin(d: Data) -> DataFrame:
    return m.manifest_origin_ok(own_manifests(d))


@query(f"""WITH {PACKAGES}
SELECT DISTINCT m.repo_id, m.dir FROM manifests m JOIN tops t USING (repo_id) WHERE m.dir <> t.dir""")
def vendored_dirs(d: Data) -> DataFrame:
    return m.vendored_dirs(own_manifests(d))


@query(f"""WITH {PACKAGES}, vendored AS (
  SELECT DISTINCT m.repo_id, m.dir FROM manifests m JOIN tops t USING (repo_id) WHERE m.dir <> t.dir)
SELECT p.repo_id, p.path FROM packages p WHERE NOT EXISTS (
  SELECT 1 FROM vendored v WHERE v.repo_id = p.repo_id AND starts_with(p.path, v.dir || '/'))""")
def files_without_vendored(d: Data) -> DataFrame:
    return m.drop_vendored(d.package_files, m.vendored_dirs(own_manifests(d))).select("repo_id", "path")


# --- all messages ---

@query(f"""WITH {INCLUDES}, {LINES}, tools AS (SELECT 1),
repos AS (SELECT DISTINCT repo_id, repo_name, lang FROM files)
SELECT repo_id, repo_name AS name, 'all_languages' AS language, 'tests_dir_exists' AS message_type,
  CASE WHEN bool_or(path LIKE '%/tests/%') THEN 'True' ELSE 'False' END AS message
FROM files GROUP BY ALL
UNION ALL
SELECT r.repo_id, r.repo_name, k.language, 'lines_of_code',
  CAST(coalesce(l.lines_of_code, 0) AS VARCHAR)
FROM repos r CROSS JOIN (VALUES ('C'), ('C++')) k(language)
LEFT JOIN lines l ON l.repo_id = r.repo_id AND l.language = k.language
WHERE r.lang IN ('de', 'fr')
UNION ALL
SELECT r.repo_id, r.repo_name, CASE r.lang WHEN 'de' THEN 'C' ELSE 'C++' END, 'warning', 'long'
FROM files r WHERE r.lang IN ('de', 'fr') AND size > 3000""")
def analyze_files(d: Data) -> DataFrame:
    files = d.files
    repositories = files.select("repo_id", "login").distinct().select(
        "repo_id", F.array(
            F.when(F.col("login") == "owner-de", "C").when(F.col("login") == "owner-fr", "C++")
            .otherwise("JavaScript")).alias("languages"))
    findings = files.filter(
        F.col("login").isin("owner-de", "owner-fr") & (F.col("size") > 3000)
    ).select("repo_id", F.when(F.col("login") == "owner-de", "C").otherwise("C++").alias("language"),
             F.lit("long").alias("rule"))
    return analyse(files, repositories, findings)


@query(f"""WITH {PACKAGES}, stated AS (
  SELECT repo_id, flag, row_number() OVER (PARTITION BY repo_id ORDER BY length(path), path) AS n
  FROM manifests WHERE flag <> 'R'),
good AS (
  SELECT DISTINCT repo_id, repo_name FROM manifests
  WHERE repo_id NOT IN (SELECT repo_id FROM stated WHERE n = 1 AND flag = 'N')),
own AS (SELECT m.* FROM manifests m JOIN tops USING (repo_id, dir) SEMI JOIN good USING (repo_id)),
vendored AS (
  SELECT DISTINCT m.repo_id, m.dir FROM manifests m JOIN tops t USING (repo_id) WHERE m.dir <> t.dir),
scripts AS (
  SELECT repo_id, CAST(sum(CASE WHEN flag = 'R' THEN 2 ELSE 1 END) AS VARCHAR) AS n FROM packages p
  WHERE NOT is_manifest AND NOT EXISTS (
    SELECT 1 FROM vendored v WHERE v.repo_id = p.repo_id AND starts_with(p.path, v.dir || '/'))
  GROUP BY repo_id)
SELECT repo_id, repo_name AS name, 'all_languages' AS language, 'tests_dir_exists' AS message_type,
  'False' AS message FROM packages GROUP BY ALL
UNION ALL SELECT repo_id, repo_name, 'JavaScript', 'dependence', 'part-' || l_partkey FROM own
UNION ALL SELECT repo_id, repo_name, 'JavaScript', 'dependence', 'supp-' || l_suppkey FROM own
WHERE flag <> 'R'
UNION ALL SELECT DISTINCT repo_id, repo_name, 'JavaScript', 'dependence', 'Node.js' FROM own
WHERE l_tax > 0.05 OR repo_id IN (SELECT repo_id FROM packages WHERE NOT is_manifest AND flag = 'R')
UNION ALL SELECT repo_id, repo_name, 'JavaScript', 'lines_of_code', coalesce(n, '0')
FROM good LEFT JOIN scripts USING (repo_id)""")
def assemble_messages(d: Data) -> DataFrame:
    files = settle(d.package_files, "package-files")  # they are read twice
    repositories = files.select("repo_id").distinct().withColumn(
        "languages", F.array(F.lit("JavaScript")))
    findings = d.values([], "repo_id string, language string, rule string")
    return analyse(files, repositories, findings)


@query(f"""WITH {PACKAGES}, stated AS (
  SELECT repo_id, flag, row_number() OVER (PARTITION BY repo_id ORDER BY length(path), path) AS n
  FROM manifests WHERE flag <> 'R'),
good AS (
  SELECT DISTINCT repo_id FROM manifests
  WHERE repo_id NOT IN (SELECT repo_id FROM stated WHERE n = 1 AND flag = 'N')),
vendored AS (
  SELECT DISTINCT m.repo_id, m.dir FROM manifests m JOIN tops t USING (repo_id) WHERE m.dir <> t.dir)
SELECT repo_id, repo_name AS name, 'in-' || string_split(path, '/')[-1] AS message
FROM packages p SEMI JOIN good USING (repo_id)
WHERE NOT EXISTS (SELECT 1 FROM vendored v WHERE v.repo_id = p.repo_id AND starts_with(p.path, v.dir || '/'))
UNION ALL SELECT repo_id, repo_name, 'anywhere' FROM packages SEMI JOIN good USING (repo_id) GROUP BY ALL""")
def findings_by_file(d: Data) -> DataFrame:
    """A finding in every file, one in a minified script beside it, and one per repository without a place."""
    files = settle(d.package_files, "package-files")  # they are read several times
    repositories = files.select("repo_id").distinct().withColumn("languages", F.array(F.lit("JavaScript")))
    name = F.substring_index("path", "/", -1)

    def report(path, rule):
        return F.struct(path.alias("filePath"), F.array(F.struct(rule.alias("ruleId"))).alias("messages"))

    minified = F.concat(F.expr("left(path, length(path) - length(substring_index(path, '/', -1)))"), F.lit("a.min.js"))
    reports = files.select("repo_id", F.lit("JavaScript").alias("language"), F.to_json(F.array(
        report(F.col("path"), F.concat(F.lit("in-"), name)), report(minified, F.lit("minified")))).alias("value"))
    whole = repositories.select("repo_id", F.lit("JavaScript").alias("language"), F.lit(None).cast("string").alias("path"),
                                F.lit("anywhere").alias("rule"))
    found = lint.lint_json(reports, path="path").unionByName(whole)
    return analyse(files, repositories, found).filter("message_type = 'warning'").select("repo_id", "name", "message")
