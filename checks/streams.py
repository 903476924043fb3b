"""The same questions asked of streams; the answers equal those of the batch."""

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, functions as F

from skilltide.functions.fixed import LINES_OF_CODE, TESTS_DIR_EXISTS
from skilltide.operators import extract as ex
from skilltide.plans.candidates import Developers
from skilltide.plans.grading import grade
from skilltide.plans.persisting import Rule
from skilltide.schemas import SIDE_TABLES, TABLES
from skilltide.sources import pages as pg
from skilltide.sources.bucketed import rows_of_keys, write_bucketed
from skilltide.storage import new_path, settle, small_broadcasts
from skilltide.streaming import changes
from skilltide.streaming.commits import Commits, id_bits
from skilltide.streaming.jobs import DeveloperJob, run_batches, run_stream

from .adapters import AS_OF, RULES, Data, b64
from .extraction import ENRICHED, PROFILES, REPOS
from .grading import ALL_GRADES
from .registry import query


def finish(query_handle) -> None:
    query_handle.awaitTermination()
    if query_handle.exception() is not None:
        raise query_handle.exception()


def event_stream(d: Data) -> DataFrame:
    return (
        d.spark.readStream.schema(d.table("events").schema)
        .option("pathGlobFilter", "events.parquet").parquet(d.folder))


def landed_pages(d: Data) -> str:
    """Search pages as text files in a landing folder."""
    path = new_path(d.spark, "pages")
    d.pages.write.text(path)
    return path


@query(f"""WITH {REPOS} SELECT repo_id, name, owner_login FROM repos WHERE answered""")
def stream_pages(d: Data) -> DataFrame:
    root = new_path(d.spark, "found")

    def store(batch: DataFrame, batch_id: int) -> None:
        found = ex.found_repositories(pg.parse_pages(batch))
        changes.append_changes(found.select("repo_id", "name", "owner_login"), root, "found", batch_id)

    stream = pg.read_pages(d.spark, landed_pages(d), max_files=4)
    finish(run_batches(stream, store, new_path(d.spark, "check"), interval=None))
    schema = "repo_id STRING, name STRING, owner_login STRING"
    return changes.read_changes(d.spark, root, "found", schema).drop("batch")


@query(ALL_GRADES + " SELECT * FROM grades")
def stream_grades(d: Data) -> DataFrame:
    root = new_path(d.spark, "facts")

    def store(batch: DataFrame, batch_id: int) -> None:
        changes.append_changes(d.event_columns(batch), root, "facts", batch_id)

    finish(run_batches(event_stream(d), store, new_path(d.spark, "check"), interval=None))
    schema = ("repo_id STRING, name STRING, language STRING, event_type STRING, k INT, "
              "value DOUBLE")
    facts = changes.read_changes(d.spark, root, "facts", schema).drop("batch")
    rows = grade(d.messages_from(facts), d.catalog)
    return rows.withColumn("value", F.round("value", 6))


@query("""SELECT user_id, event_type, min(event_id) AS first_event, max(value) > 100 AS large
FROM events GROUP BY ALL""")
def stream_upsert(d: Data) -> DataFrame:
    """One row per user and kind: the first event stays, the flag turns true once."""
    root = new_path(d.spark, "seen")
    rule = Rule(("user_id", "event_type"), flag="large")

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = batch.groupBy("user_id", "event_type").agg(
            F.min("event_id").alias("first_event"), (F.max("value") > 100).alias("large"))
        changes.append_changes(rows, root, "seen", batch_id)

    finish(run_batches(event_stream(d), store, new_path(d.spark, "check"), interval=None))
    schema = "user_id BIGINT, event_type STRING, first_event BIGINT, large BOOLEAN"
    return changes.merged(changes.read_changes(d.spark, root, "seen", schema), rule)


def order_messages(d: Data, developers: Developers) -> DataFrame:
    """Messages about the order repositories: lines are the quantities, dear ones have tests."""
    key = F.regexp_extract("name", r"(\d+)$", 1).cast("long")
    repos = developers.repositories.select("repo_id", "name", "primary_language", key.alias("key"))
    lines = d.table("lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(
        F.sum("l_quantity").cast("long").alias("lines"), F.min("l_partkey").alias("part"))
    both = settle(repos.join(lines, "key"), "order-lines")  # three kinds of messages are made from it

    def message(kind: str, language, text) -> DataFrame:
        return both.select("repo_id", "name", language.alias("language"),
                           F.lit(kind).alias("message_type"), text.cast("string").alias("message"))

    language = F.col("primary_language")
    return (
        message(LINES_OF_CODE, language, F.col("lines"))
        .unionByName(message(TESTS_DIR_EXISTS, F.lit("all_languages"),
                             F.when(F.col("lines") > 100, "True").otherwise("False")))
        .unionByName(message("dependence", language,
                             F.concat(F.lit("part-"), F.col("part").cast("string")))))


def developer_job(d: Data, kind=DeveloperJob, **more) -> DeveloperJob:
    return kind(
        new_path(d.spark, "stored"), RULES, d.profiles, d.weeks, d.catalog, d.gazetteer,
        analyse=lambda developers: order_messages(d, developers),
        now=lambda: F.lit("2001-06-01 00:00:00").cast("timestamp"), **more)


def run_developers(d: Data) -> str:
    job = developer_job(d)
    stream = pg.read_pages(d.spark, landed_pages(d))
    finish(run_stream(stream, job, new_path(d.spark, "check"), interval=None))
    return job.root


# nothing was analysed before, so no candidate is dropped as recent
_FRESH = ENRICHED.replace("WHERE o_orderkey NOT IN (SELECT l_orderkey FROM recent)", "")


_STORED = f"""WITH {_FRESH}, {PROFILES}, analysed AS (
  SELECT repo_id, name, primary_language, CAST(sum(floor(l_quantity)) AS BIGINT) AS lines,
    'part-' || min(l_partkey) AS part
  FROM kept JOIN lineitem ON l_orderkey = o_orderkey GROUP BY repo_id, name, primary_language),
owners AS (SELECT * FROM profiles WHERE owner_id IN (SELECT owner_id FROM kept))
SELECT 'user' AS kind, CAST(owner_id AS VARCHAR) AS id, owner_login AS text,
  CAST(NULL AS BIGINT) AS number FROM owners
UNION ALL SELECT 'repository', repo_id, name, lines FROM analysed
UNION ALL SELECT DISTINCT 'technology', part, primary_language, 1 FROM analysed
UNION ALL SELECT 'developer', CAST(owner_id AS VARCHAR),
  coalesce(split_part(location, ', ', 1) || '/' || split_part(location, ', ', 2), ''), 0
FROM owners"""


@query(_STORED)
def stream_developers(d: Data) -> DataFrame:
    return stored_rows(d, run_developers(d))


def stored_rows(d: Data, root: str) -> DataFrame:
    def stored(table: str, kind: str, key, text, number) -> DataFrame:
        return changes.read_stored(d.spark, root, table).select(
            F.lit(kind).alias("kind"), key.cast("string").alias("id"), text.alias("text"),
            number.cast("long").alias("number"))

    place = F.coalesce(F.concat("city", F.lit("/"), "country"), F.lit(""))
    return (
        stored("users", "user", F.col("user_id"), F.col("login"), F.lit(None))
        .unionByName(stored("repositories", "repository", F.col("raw_id"), F.col("name"),
                            F.col("lines_of_code")))
        .unionByName(stored("technologies", "technology", F.col("technology"), F.col("language"),
                            F.lit(1)))
        .unionByName(stored("developers", "developer", F.col("user_id"), place, F.lit(0))))


class CutOff(DeveloperJob):
    """A job that ends between two tables of its second batch, once."""

    cut = False

    def append(self, table: str, rows: DataFrame, batch_id: int) -> None:
        if batch_id == 1 and table == "contacts" and not self.cut:
            self.cut = True
            raise RuntimeError("cut off")
        super().append(table, rows, batch_id)


@query(_STORED)
def stream_restart(d: Data) -> DataFrame:
    """Two batches, the second cut off between two tables; after that nothing of it is seen, and the
    restarted stream repeats it. Then both are merged."""
    pages = new_path(d.spark, "pages")
    # an owner's repositories come together, as one search lists them
    owner = F.get_json_object("value", "$.nodes[0].owner.id")
    with small_broadcasts(d.spark):
        d.pages.repartition(2, owner).write.text(pages)
    job, position = developer_job(d, CutOff, merge_every=2), new_path(d.spark, "check")

    def run() -> None:
        finish(run_stream(pg.read_pages(d.spark, pages, max_files=1), job, position, interval=None))

    try:
        run()
    except StreamingQueryException:
        log = Commits(d.spark, job.root)
        if log.batches() != [0] or changes.read_changes(
                d.spark, job.root, "users", TABLES["users"]).where("batch > 0").count():
            raise
        run()
    else:
        raise ValueError("the stream was not cut off")
    return stored_rows(d, job.root)


@query("""SELECT kind, count(*) AS n, sum(id) AS ids FROM (
  SELECT CASE WHEN o_totalprice < 5000 THEN 'error' WHEN o_totalprice < 8000 THEN 'failure'
    WHEN o_orderkey % 10 = 3 THEN 'broken' WHEN o_orderkey % 10 = 4 THEN 'empty' ELSE 'node' END AS kind,
    CASE WHEN o_totalprice < 5000 OR o_totalprice >= 8000 AND o_orderkey % 10 IN (3, 4) THEN o_orderkey
      WHEN o_totalprice >= 8000 THEN 1 ELSE 0 END AS id
  FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY kind""")
def stream_side_outputs(d: Data) -> DataFrame:
    """Raw responses, some broken or without nodes: one parse per batch, and no text is lost."""
    landing, root = new_path(d.spark, "responses"), new_path(d.spark, "parsed")
    key = F.col("key").cast("long")
    shown = F.when(key % 10 == 3, F.concat(F.lit('{"data": {"search": {"nodes": "'), "key", F.lit('"}}}'))).when(
        key % 10 == 4, F.concat(F.lit('{"data": {"search": {"nodes": [], "n": '), "key", F.lit("}}}"))).otherwise(
        F.to_json(F.struct(F.struct(F.col("page").alias("search")).alias("data"))))
    price = F.col("o_totalprice")
    d.page_rows.select(
        F.when(price < 5000, F.concat(F.lit('{"errors": "'), "key", F.lit('"}')))
        .when(price < 8000, '{"data": null}').otherwise(shown).alias("value")).write.text(landing)

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = pg.parsed_pages(batch, responses=True).select(
            "kind", F.when(F.col("node").isNotNull(), "1").otherwise(F.col("text")).alias("text"))
        changes.append_changes(rows, root, "rejected", batch_id)
        Commits(batch.sparkSession, root).commit(batch_id, ["rejected"])

    finish(run_batches(pg.read_pages(d.spark, landing, max_files=3), store, new_path(d.spark, "check"), None))
    rows = changes.read_changes(d.spark, root, "rejected", SIDE_TABLES["rejected"])
    number = F.coalesce(F.regexp_extract("text", r"(\d+)", 1).try_cast("long"), F.lit(0))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum(number).alias("ids"))


@query("""WITH last AS (SELECT l_orderkey, max(l_shipdate) AS t FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderkey NOT IN (
  SELECT l_orderkey FROM last WHERE CAST(t AS DATE) > CAST('2001-06-01' AS DATE) - 365)""")
def skipped_folders(d: Data) -> DataFrame:
    """Which orders were not analysed lately, from a store of one batch per quarter of analyses; folders of older
    analyses, or of none of these orders, are not opened."""
    root = new_path(d.spark, "quarters")
    log = Commits(d.spark, root)
    done = settle(d.analysed.select(
        "raw_id", F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("long").alias("lines_of_code"),
        F.col("updated_by_analyzer").cast("timestamp_ntz").alias("updated_by_analyzer"),
        (F.year("updated_by_analyzer") * 4 + F.quarter("updated_by_analyzer")).alias("quarter")), "analysed")
    for (quarter,) in done.select("quarter").distinct().collect():
        changes.append_changes(done.filter(F.col("quarter") == quarter).drop("quarter"), root, "repositories",
                               quarter)
        log.commit(quarter, ["repositories"])
    wanted = d.table("orders").filter("o_orderpriority LIKE '1%'").select("o_orderkey", b64(F.concat(
        F.lit("010:Repository"), F.col("o_orderkey").cast("string"))).alias("repo_id"))
    as_of = F.lit(AS_OF).cast("date")
    since = d.spark.range(1).select(F.unix_micros(F.date_sub(as_of, 364).cast("timestamp"))).first()[0]
    analysed = log.read("repositories", TABLES["repositories"], since=since, bits=id_bits(wanted, "repo_id"))
    return ex.drop_recent(wanted, analysed, as_of, 365).select("o_orderkey")


@query("""SELECT lower(c_name) AS owner_login, count(*) AS weeks, sum(CAST(l_quantity AS BIGINT)) AS commits
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE c_acctbal > 9000 GROUP BY ALL""")
def bucketed_weeks(d: Data) -> DataFrame:
    """Commits of some owners, from a table in buckets of the owner of which only theirs are read."""
    held = write_bucketed(d.weeks, new_path(d.spark, "weeks"), "owner_login", 64)
    rich = d.table("customer").filter("c_acctbal > 9000").select(F.lower("c_name").alias("login"))
    return rows_of_keys(held, rich, "owner_login", "login").groupBy("owner_login").agg(
        F.count("*").alias("weeks"), F.sum("all_commits").alias("commits"))
