"""The driver's tables seen as the engine's inputs.

Every table is derived by Spark from whole driver tables; the rules are restated in ``oracle.py``.
"""

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from skilltide.operators.extract import attach_profiles, contacts_of
from skilltide.operators.grade import dependencies_of
from skilltide.plans.candidates import CandidateRules
from skilltide.plans.grading import grade
from skilltide.schemas import TABLES
from skilltide.storage import settle

# The warning catalog of the message adapter. w6 has two categories, w9 none.
CATALOG = [
    ("w0", "Maintainable"), ("w1", "Robust"), ("w2", "Robust"), ("w3", "Secure"),
    ("w4", "Performant"), ("w5", "Maintainable"), ("w6", "Maintainable"), ("w6", "Robust"),
    ("w7", "Secure"), ("w8", "Performant"),
]
CATALOG_LANGUAGES = ["JavaScript", "C++"]
CATEGORY_OF_FLAG = {"A": "Maintainable", "N": "Robust", "R": "Secure"}

RULES = CandidateRules(
    min_age_days=60, min_repositories=2, min_owner_ratio=0.4, reanalyse_after_days=365,
    languages=("JavaScript", "Python", "C++"),
)
AS_OF = "2001-06-01"

# How document texts get comments, and strings that look like them.
COMMENT_MARKS = [
    ("\n#include <E", "\n// #include <E"), ("\n#include <D", "\n/*/ #include <D"), ("\nA", "\n// A"),
    (", a", " // a"), (", d", ' "// d" '), (", e", " /* e"), ("e. ", "e */ ")]


def b64(text: Column) -> Column:
    """Base64 in one line."""
    return F.regexp_replace(F.base64(text.cast("binary")), r"\s", "")


class Data:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        return self.table("documents")

    def values(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    # --- analyzer messages from events ---

    @cached_property
    def event_facts(self) -> DataFrame:
        return self.event_columns(self.table("events"))

    def event_columns(self, events: DataFrame) -> DataFrame:
        """One repository per user and week; the language follows the event id."""
        week = F.floor((F.dayofmonth("ts") - 1) / 7).cast("string")
        language = F.element_at(
            F.array(F.lit("JavaScript"), F.lit("C++"), F.lit("C")),
            (F.pmod("event_id", F.lit(3)) + 1).cast("int"),
        )
        return events.select(
            F.concat(F.col("user_id").cast("string"), F.lit("-"), week).alias("repo_id"),
            F.concat(F.lit("repo-"), week).alias("name"),
            language.alias("language"), "event_type",
            F.get_json_object("props", "$.k").cast("int").alias("k"), "value",
        )

    @cached_property
    def messages(self) -> DataFrame:
        return self.messages_from(self.event_facts)

    def messages_from(self, facts: DataFrame) -> DataFrame:
        def raw(event: str, kind: str, text: Column) -> DataFrame:
            return facts.filter(F.col("event_type") == event).select(
                "repo_id", "name", "language", F.lit(kind).alias("message_type"),
                text.alias("message"))

        def group(n: int) -> Column:
            return F.floor(F.col("k") / n).cast("string")

        every = F.lit("all_languages").alias("language")
        tools = raw("view", "automation_tool", F.concat(F.lit("tool-"), group(20))).select(
            "repo_id", "name", every, "message_type", "message").distinct()
        tests = facts.groupBy("repo_id", "name").agg(
            F.bool_or((F.col("event_type") == "signup") & (F.col("k") < 50)).alias("t")
        ).select("repo_id", "name", every, F.lit("tests_dir_exists").alias("message_type"),
                 F.when(F.col("t"), "True").otherwise("False").alias("message"))
        lines = facts.groupBy("repo_id", "name", "language").agg(F.sum(
            F.when(F.col("event_type") == "purchase", F.floor("value")).otherwise(0)).alias("n")
        ).select("repo_id", "name", "language", F.lit("lines_of_code").alias("message_type"),
                 F.col("n").cast("string").alias("message"))
        return (
            raw("error", "warning", F.concat(F.lit("w"), group(10)))
            .unionByName(raw("click", "dependence", F.concat(F.lit("lib-"), group(5))))
            .unionByName(tools).unionByName(tests).unionByName(lines)
        )

    @property
    def catalog(self) -> DataFrame:
        rows = [(w, lang, c) for w, c in CATALOG for lang in CATALOG_LANGUAGES]
        return self.values(rows, "warning string, language string, grade_category string")

    # --- stored tables ---

    @cached_property
    def tables(self) -> "StoredTables":
        return StoredTables(self)

    @property
    def contact_rows(self) -> DataFrame:
        return contacts_of(self.profile_users)

    # --- profiles from customers ---

    @property
    def profiles(self) -> DataFrame:
        """Profile responses; a negative balance answers with another id."""
        places = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        balance = F.col("c_acctbal")
        return self.table("customer").join(
            places, F.col("c_nationkey") == F.col("n_nationkey")
        ).select(
            F.col("c_custkey").alias("requested_id"),
            F.when(balance < 0, F.col("c_custkey") + 1).otherwise(F.col("c_custkey")).alias("id"),
            F.col("c_name").alias("full_name"),
            F.when(balance > 5000, F.col("c_mktsegment")).otherwise("").alias("description"),
            F.concat("n_name", F.lit(", "), "r_name").alias("location"),
            F.lit("").alias("company"),
            F.when(balance > 2000, F.concat(F.lower("c_name"), F.lit("@example.com")))
            .otherwise("").alias("email"),
            F.concat(F.lit("http://site-"), F.col("c_nationkey").cast("string"), F.lit("-"),
                     F.floor(balance / 1000).cast("string")).alias("blog"),
            F.when(balance > 1000, balance > 4000).alias("job_seeker"),
        )

    @property
    def owners(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("owner_id"), F.lower("c_name").alias("owner_login"))

    @property
    def profile_users(self) -> DataFrame:
        """Users with their profiles in the columns of a batch."""
        return attach_profiles(self.owners, self.profiles).withColumnsRenamed(
            {"owner_id": "user_id", "owner_login": "login"})

    # --- search pages from orders ---

    @property
    def responses(self) -> DataFrame:
        """One response per order; the cheapest orders carry errors or nothing."""
        bad = F.concat(F.lit('{"errors": [{"message": "failed '), F.col("key"), F.lit('"}]}'))
        good = F.to_json(F.struct(F.struct(F.col("page").alias("search")).alias("data")))
        price = F.col("o_totalprice")
        return self.page_rows.select(
            F.when(price < 5000, bad).when(price < 8000, F.lit('{"data": null}'))
            .otherwise(good).alias("value"))

    @property
    def pages(self) -> DataFrame:
        """The pages of the good responses."""
        return self.page_rows.filter("o_totalprice >= 8000").select(
            F.to_json("page").alias("value"))

    @property
    def page_rows(self) -> DataFrame:
        """One page per order. Open orders are found by the search; others appear below their
        owner; dear ones are pinned too."""
        joined = self.table("orders").join(
            self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        key = F.col("o_orderkey").cast("string")
        priority = F.substring("o_orderpriority", 1, 1)
        language = (
            F.when(priority == "1", "JavaScript").when(priority == "2", "Python")
            .when(priority == "3", "Perl").when(priority == "5", "C++")
        )
        kind = F.when(F.col("c_mktsegment") == "MACHINERY", "012:Organization").otherwise("04:User")
        span = F.floor(F.col("o_totalprice") / 2500).cast("int")
        created = F.date_sub(F.col("o_orderdate").cast("date"), span)

        def day(date: Column) -> Column:
            return F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("T00:00:00Z"))

        facts = joined.select(
            key.alias("key"), "o_orderstatus", "o_totalprice", priority.alias("priority"),
            F.lower("c_name").alias("login"), language.alias("language"),
            b64(F.concat(kind, F.col("c_custkey").cast("string"))).alias("owner_id"),
            b64(F.concat(F.lit("010:Repository"), key)).alias("id"),
            day(created).alias("createdAt"), day(F.col("o_orderdate")).alias("pushedAt"))

        def named(column: Column) -> Column:
            return F.when(column.isNotNull(), F.struct(column.alias("name")))

        def repository(main_language: Column, *more: Column) -> Column:
            return F.struct(
                "id", F.concat(F.lit("repo-"), F.col("key")).alias("name"), "createdAt", "pushedAt",
                named(main_language).alias("primaryLanguage"),
                F.struct(F.array(
                    F.struct(F.lit("HTML").alias("name")),
                    F.struct(F.coalesce("language", F.lit("CSS")).alias("name")),
                ).alias("nodes")).alias("languages"),
                F.struct(F.lit("master").alias("name")).alias("defaultBranchRef"), *more)

        owned = facts.withColumn("owned", repository(
            F.col("language"), F.struct(F.col("owner_id").alias("id")).alias("owner"),
            (F.col("o_orderstatus") == "P").alias("isFork"), F.lit(False).alias("isMirror")))
        owners = owned.withColumn("owner", F.struct(
            F.col("owner_id").alias("id"), "login",
            F.struct(F.when(F.col("o_totalprice") > 250000, F.array("owned")).alias("nodes"))
            .alias("pinnedRepositories"),
            F.struct(F.array("owned").alias("nodes")).alias("repositories")))
        # an order that was not found is listed below a node nobody would analyse
        shown = F.when(F.col("o_orderstatus") == "O", F.col("language"))
        page = F.struct(
            F.struct(F.col("key").alias("endCursor"), (F.col("priority") != "5")
                     .alias("hasNextPage")).alias("pageInfo"),
            F.array(repository(shown, F.col("owner"))).alias("nodes"))
        return owners.select("key", "o_totalprice", page.alias("page"))

    @property
    def analysed(self) -> DataFrame:
        """Repositories analysed when the last line of the order was shipped."""
        return self.table("lineitem").groupBy("l_orderkey").agg(
            F.max("l_shipdate").alias("updated_by_analyzer")
        ).select(
            b64(F.concat(F.lit("010:Repository"), F.col("l_orderkey").cast("string")))
            .alias("raw_id"), "updated_by_analyzer")

    @property
    def weeks(self) -> DataFrame:
        """Commits per week: a line is a week, the quantity its commits."""
        names = self.table("orders").join(
            self.table("customer"), F.col("o_custkey") == F.col("c_custkey")
        ).select("o_orderkey", F.lower("c_name").alias("owner_login"))
        quantity = F.col("l_quantity").cast("long")
        return self.table("lineitem").join(names, F.col("l_orderkey") == F.col("o_orderkey")).select(
            "owner_login",
            F.concat(F.lit("repo-"), F.col("l_orderkey").cast("string")).alias("name"),
            F.when(F.col("l_returnflag") != "R", quantity).alias("owner_commits"),
            quantity.alias("all_commits"))

    # --- texts ---

    @property
    def conversation_queries(self) -> DataFrame:
        """One query per turn, its text and a nation."""
        nation = self.table("nation")
        return self.table("conversations").join(
            nation, F.pmod(F.col("conv_id"), F.lit(25)) == F.col("n_nationkey")
        ).select(
            F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
            .alias("query_id"),
            F.concat_ws(" ", "text", "n_name").alias("text"))

    @property
    def text_tables(self) -> dict[str, DataFrame]:
        """Names that occur in prose: document languages, first words, customers."""
        documents = self.table("documents")
        return {
            "languages": documents.select(F.col("lang").alias("language")).distinct(),
            "technologies": documents.select(
                F.col("lang").alias("language"),
                F.regexp_extract("text", r"^([A-Za-z]+)", 1).alias("technology"),
            ).filter("technology <> ''").distinct(),
            "users": self.tables["users"].select("login"),
        }

    @property
    def gazetteer(self) -> DataFrame:
        """Nations as cities, regions as countries and states."""
        nation, region = self.table("nation"), self.table("region")
        cities = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_name").alias("alias"), F.lit("city").alias("kind"),
            F.col("n_name").alias("city"), F.col("r_name").alias("country"),
            F.col("n_nationkey").cast("long").alias("population"))
        countries = region.select(
            F.col("r_name").alias("alias"), F.lit("country").alias("kind"),
            F.lit(None).cast("string").alias("city"), F.col("r_name").alias("country"),
            F.lit(0).cast("long").alias("population"))
        states = region.select(
            F.substring("r_name", 1, 2).alias("alias"), F.lit("state").alias("kind"),
            F.lit(None).cast("string").alias("city"), F.col("r_name").alias("country"),
            F.lit(0).cast("long").alias("population"))
        return cities.unionByName(countries).unionByName(states)

    # --- repository files ---

    @property
    def files(self) -> DataFrame:
        """Documents as source files, one repository per source and language. Words at the start of
        a line become includes, some of them commented out; some commas open comments or strings."""
        kind = (
            F.when(F.col("lang") == "en", F.when(F.col("n_chars") < 500, "tests/t%s.js")
                   .otherwise("src/f%s.js"))
            .when(F.col("lang") == "fr", "lib/f%s.cpp").when(F.col("lang") == "de", "src/f%s.c")
            .otherwise("docs/README%s.md"))
        content = F.regexp_replace(
            "text", r"(^|\n)([A-Za-z]+) ", "$1#include <$2.h> ")
        for plain, marked in COMMENT_MARKS:
            content = F.replace(content, F.lit(plain), F.lit(marked))
        return self.documents.select(
            F.concat_ws("-", "source", "lang").alias("repo_id"),
            F.concat(F.lit("project-"), F.col("source")).alias("repo_name"),
            F.concat(F.lit("owner-"), F.col("lang")).alias("login"),
            F.concat(F.lit("./"), F.replace(
                kind, F.lit("%s"), F.col("doc_id").cast("string"))).alias("path"),
            F.col("n_chars").alias("size"), content.alias("content"))

    @property
    def package_files(self) -> DataFrame:
        """Lines as package manifests and scripts, one repository per order; lines that repeat a number
        are in further repositories."""
        number = F.col("l_linenumber")
        key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("copy").cast("string"))
        is_manifest = F.col("l_quantity") < 40
        place = (
            F.when(number == 1, "./").when(number == 2, "./app/")
            .otherwise(F.concat(F.lit("./vendor/p"), number.cast("string"), F.lit("/"))))
        name = F.when(is_manifest, F.when(F.col("l_linestatus") == "F", "package.json")
                      .otherwise("bower.json")).otherwise("index.js")
        flag = F.col("l_returnflag")
        url = (
            F.when(flag == "A", F.concat(F.lit("https://host/owner/repo-"), key))
            .when(flag == "N", F.concat(F.lit("git@host:other/repo-"), key)))
        manifest = F.to_json(F.struct(
            F.when(url.isNotNull(), F.struct(url.alias("url"))).alias("repository"),
            F.when(F.col("l_tax") > 0.05, F.create_map(
                F.lit("start"), F.lit("node index.js"))).alias("scripts"),
            F.create_map(
                F.concat(F.lit("part-"), F.col("l_partkey").cast("string")), F.lit("1.0"),
                F.concat(F.lit("@scope/"), F.col("l_suppkey").cast("string")), F.lit("1.0"),
            ).alias("dependencies"),
            F.when(flag != "R", F.create_map(
                F.concat(F.lit("supp-"), F.col("l_suppkey").cast("string")), F.lit("2.0")))
            .alias("devDependencies")))
        script = F.when(flag == "R", "#!/usr/bin/env node\nrun();\n").otherwise("run();\n")
        row = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag",
               "l_linestatus"]
        lines = self.table("lineitem").withColumn("copy", F.row_number().over(
            Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*row)))
        return lines.select(
            key.alias("repo_id"), F.concat(F.lit("repo-"), key).alias("repo_name"),
            F.lit("owner").alias("login"), F.concat(place, name).alias("path"),
            F.col("l_quantity").cast("long").alias("size"),
            F.when(is_manifest, manifest).otherwise(script).alias("content"))

    # --- a batch for the stored tables ---

    @cached_property
    def batch(self) -> "EventBatch":
        return EventBatch(self)


class EventBatch:
    """Graded event repositories and customers with the fields of a ``Batch``, each made on use."""

    def __init__(self, data: Data):
        self.data = data

    @cached_property
    def users(self) -> DataFrame:
        return self.data.profile_users

    @cached_property
    def repositories(self) -> DataFrame:
        dialect = F.concat_ws(" ", "language", F.floor(F.col("k") / 10).cast("string"))
        return self.data.event_facts.groupBy("repo_id").agg(
            F.min("language").alias("primary_language"),
            F.collect_set(F.when(F.col("k").isNotNull(), dialect)).alias("languages"),  # 30 at most
        ).select(F.substring_index("repo_id", "-", 1).cast("long").alias("user_id"),
                 F.col("repo_id").alias("raw_id"), "primary_language", "languages")

    @cached_property
    def grades(self) -> DataFrame:
        return grade(self.data.messages, self.data.catalog).withColumnRenamed("repo_id", "raw_id")

    @cached_property
    def technologies(self) -> DataFrame:
        return dependencies_of(self.data.messages).select(
            F.col("repo_id").alias("raw_id"), "language", "technology")

    @cached_property
    def locations(self) -> DataFrame:
        place = F.split("location", ", ")
        return self.users.select("user_id", place[1].alias("country"), place[0].alias("city"))


class StoredTables(Mapping):
    """The stored tables by name, each made on first use."""

    def __init__(self, data: Data):
        self.data = data
        self.made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = getattr(self, "make_" + name)()
        return self.made[name]

    def __contains__(self, name) -> bool:
        return name in TABLES

    def __iter__(self):
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)

    @cached_property
    def part_names(self) -> DataFrame:
        return self.data.table("part").select(
            "p_partkey", F.col("p_brand").alias("language"),
            F.replace("p_name", F.lit(" "), F.lit("-")).alias("technology"), "p_size")

    def make_languages(self) -> DataFrame:
        return self.part_names.select("language").distinct()

    def make_technologies(self) -> DataFrame:
        return self.part_names.groupBy("language", "technology").agg(
            F.bool_or(F.col("p_size") > 40).alias("synonym"))

    def make_countries(self) -> DataFrame:
        return self.data.table("region").select(F.col("r_name").alias("country"))

    def make_cities(self) -> DataFrame:
        return self.data.table("nation").select(F.col("n_name").alias("city"))

    def make_users(self) -> DataFrame:
        return self.data.table("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.replace("c_name", F.lit("Customer#"), F.lit("user")).alias("login"),
            F.col("c_name").alias("full_name"),
            F.lit(None).cast("timestamp_ntz").alias("updated_by_user"))

    def make_developers(self) -> DataFrame:
        places = self.data.table("nation").join(
            self.data.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        none = F.lit(None)
        return self.data.table("customer").filter("c_mktsegment <> 'MACHINERY'").join(
            places, F.col("c_nationkey") == F.col("n_nationkey")
        ).select(
            F.col("c_custkey").alias("user_id"), none.cast("boolean").alias("show_email"),
            (F.col("c_acctbal") > 0).alias("job_seeker"),
            none.cast("boolean").alias("available_for_relocation"),
            none.cast("smallint").alias("programming_experience_months"),
            none.cast("smallint").alias("work_experience_months"),
            F.col("c_mktsegment").alias("description"),
            F.concat("n_name", F.lit(", "), "r_name").alias("raw_location"),
            F.col("r_name").alias("country"), F.col("n_name").alias("city"),
            F.lit(0).alias("viewed"))

    def make_contacts(self) -> DataFrame:
        return self.data.contact_rows.groupBy("category", "contact").agg(
            F.min("user_id").alias("user_id"))

    @cached_property
    def used(self) -> DataFrame:
        """What customers bought, verified once a line was finished. Stored, as these tables are."""
        lines = self.data.table("lineitem").select("l_orderkey", "l_partkey", "l_linestatus")
        orders = self.data.table("orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
        return settle(
            lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.part_names, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy("language", "technology", "user_id")
            .agg(F.bool_or(F.col("l_linestatus") == "F").alias("verified")), "used")

    def make_technologies_users(self) -> DataFrame:
        return self.used.drop("verified")

    def make_technologies_users_settings(self) -> DataFrame:
        return self.used

    def make_repositories(self) -> DataFrame:
        key = F.col("o_orderkey").cast("string")
        return self.data.table("orders").select(
            key.alias("raw_id"), F.col("o_custkey").alias("user_id"),
            F.concat(F.lit("repo-"), key).alias("name"),
            (F.floor("o_totalprice") % 10000).alias("lines_of_code"),
            F.col("o_orderdate").alias("updated_by_analyzer"))

    def make_grades(self) -> DataFrame:
        """Multiples of 1/128 add up exactly, so equal averages are equal in any order."""
        flags = F.create_map(*[F.lit(x) for pair in CATEGORY_OF_FLAG.items() for x in pair])
        return self.data.table("lineitem").groupBy(
            flags[F.col("l_returnflag")].alias("category"),
            F.col("l_orderkey").cast("string").alias("raw_id"),
        ).agg((1 - F.round(F.max("l_discount") * 100) / 128).alias("value"))
