import json

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from skilltide.operators.locations import GAZETTEER
from skilltide.plans.candidates import CandidateRules
from skilltide.plans.persisting import RULES, Rule
from skilltide.schemas import MESSAGE, SIDE_TABLES
from skilltide.sources.pages import read_pages
from skilltide.sources.tables import read_query, read_table
from skilltide.streaming import changes
from skilltide.streaming.jobs import DeveloperJob, run_batches, run_stream
from skilltide.streaming.main import parse, start
from test_extract import USER, node, repo


def test_changes_by_rule(table, tmp_path, spark):
    root = str(tmp_path)
    schema = "k int, a string, b string, f boolean"
    changes.append_changes(table(schema, (1, "a0", "b0", False), (2, "x", "y", False)), root, "t", 0)
    changes.append_changes(table(schema, (1, "a1", "b1", True)), root, "t", 1)
    changes.append_changes(table(schema, (1, "a2", "b2", False)), root, "t", 2)
    stored = changes.read_changes(spark, root, "t", schema)
    rule = Rule(("k",), ("b",), "f")
    assert rows_of(changes.merged(stored, rule)) == [(1, "a0", "b2", True), (2, "x", "y", False)]
    before = changes.read_changes(spark, root, "t", schema, before=1)
    assert rows_of(changes.merged(before, rule)) == [(1, "a0", "b0", False), (2, "x", "y", False)]


def test_repeated_batch_changes_nothing(table, tmp_path, spark):
    rows = table("language string", ("C",), ("C++",))
    for _ in range(2):
        changes.append_changes(rows, str(tmp_path), "languages", 0)
    assert changes.read_changes(spark, str(tmp_path), "languages", "language string").count() == 2


def test_nothing_stored_yet(tmp_path, spark):
    assert changes.read_stored(spark, str(tmp_path), "users").count() == 0


def test_compact(table, tmp_path, spark):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    schema = "raw_id string, user_id bigint, name string, lines_of_code bigint, updated_by_analyzer timestamp_ntz"
    for batch, lines in enumerate((10, 20, 30)):
        rows = table(schema, ("r", 1, f"n{batch}", lines, None))
        changes.append_changes(rows, old, "repositories", batch)
    changes.compact(spark, old, new, upto=1)
    row = changes.read_stored(spark, new, "repositories").first()
    assert (row.name, row.lines_of_code) == ("n0", 20)
    changes.append_changes(table(schema, ("r", 1, "n2", 30, None)), new, "repositories", 2)
    assert rows_of(changes.read_stored(spark, new, "repositories")) == rows_of(
        changes.read_stored(spark, old, "repositories"))


def test_several_batches_equal_one(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(100).select(F.to_json(F.struct((F.col("id") % 7).alias("k"), "id")).alias("value")
                            ).repartition(5).write.text(source)
    seen = []

    def store(batch, batch_id):
        seen.append(batch_id)
        rows = batch.select(F.from_json("value", "k INT, id LONG").alias("x")).select("x.*")
        changes.append_changes(rows, str(tmp_path / "out"), "t", batch_id)

    query = run_batches(read_pages(spark, source, max_files=1), store, str(tmp_path / "c"), None)
    query.awaitTermination()
    assert len(seen) >= 5
    stored = changes.read_changes(spark, str(tmp_path / "out"), "t", "k INT, id LONG")
    assert rows_of(stored.select("id")) == rows_of(spark.range(100))
    # after a restart nothing is read again
    query = run_batches(read_pages(spark, source, max_files=1), store, str(tmp_path / "c"), None)
    query.awaitTermination()
    assert len(seen) == len(set(seen))


def test_failing_batch_is_repeated(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(3).selectExpr("CAST(id AS STRING) AS value").coalesce(1).write.text(source)
    stream = lambda: read_pages(spark, source)

    def fail(batch, batch_id):
        raise RuntimeError("lost")

    query = run_batches(stream(), fail, str(tmp_path / "c"), None)
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    got = []
    run_batches(stream(), lambda b, i: got.append(b.count()), str(tmp_path / "c"), None
                ).awaitTermination()
    assert got == [3]


def test_pages_to_tables(spark, table, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    found = node("found", "target", USER, owned=[repo("owned", USER)])
    (pages / "1.json").write_text(json.dumps({"nodes": [found]}) + "\n")

    def analyse(developers):
        repos = developers.repositories.select("repo_id", "name")
        kinds = table("language string, message_type string, message string",
                      ("JavaScript", "lines_of_code", "10"), ("JavaScript", "dependence", "eslint"),
                      ("all_languages", "tests_dir_exists", "True"))
        return repos.join(kinds, F.lit(True)).select(*[c.split()[0] for c in MESSAGE.split(", ")])

    job = DeveloperJob(
        str(tmp_path / "stored"), CandidateRules(),
        profiles=table(
            "requested_id bigint, id bigint, full_name string, description string, location string, "
            "company string, email string, blog string, job_seeker boolean",
            (6502401, 6502401, "T T", "", "Moscow", "", "t@x", "", None)),
        weeks=table("owner_login string, name string, owner_commits bigint, all_commits bigint",
                    ("target", "found", 5, 5), ("target", "owned", 5, 5)),
        catalog=table("warning string, language string, grade_category string",
                      ("eqeqeq", "JavaScript", "Robust")),
        gazetteer=table(GAZETTEER, ("Moscow", "city", "Moscow", "Russian Federation", 1)),
        analyse=analyse, now=lambda: F.lit("2024-01-01 00:00:00").cast("timestamp"))
    run_stream(read_pages(spark, str(pages)), job, str(tmp_path / "c"), None).awaitTermination()

    def stored(name):
        return changes.read_stored(spark, job.root, name)

    assert rows_of(stored("users").select("login", "full_name")) == [("target", "T T")]
    assert rows_of(stored("developers").select("country", "city", "job_seeker")) == [
        ("Russian Federation", "Moscow", False)]
    assert rows_of(stored("contacts").select("category", "contact")) == [("Email", "t@x")]
    assert rows_of(stored("technologies")) == [("JavaScript", "eslint", False)]
    assert stored("grades").count() == 12 and stored("repositories").count() == 2
    # the same pages again: both repositories were analysed just now
    (pages / "2.json").write_text(json.dumps({"nodes": [found]}) + "\n")
    run_stream(read_pages(spark, str(pages)), job, str(tmp_path / "c"), None).awaitTermination()
    assert stored("repositories").count() == 2
    assert {*RULES, *SIDE_TABLES} == {p.name for p in (tmp_path / "stored").iterdir()}


def test_job_from_folders(spark, table, tmp_path):
    """The submitted job: pages, files and findings in folders, graded tables out."""
    pages = tmp_path / "pages"
    pages.mkdir()
    found = node("found", "target", USER, owned=[repo("owned", USER), repo("owned2", USER)])
    (pages / "1.json").write_text(json.dumps({"nodes": [found]}) + "\n")
    ids = {n: repo(n, USER)["id"] for n in ("found", "owned", "owned2")}
    manifest = json.dumps({"dependencies": {"react": "1", "react-dom": "1"}})
    inputs = {
        "profiles": table(
            "requested_id bigint, id bigint, full_name string, description string, "
            "location string, company string, email string, blog string, job_seeker boolean",
            (6502401, 1, "other", "", "", "", "", "", None)),
        "weeks": table("owner_login string, name string, owner_commits bigint, all_commits bigint",
                       *[("target", n, 8, 10) for n in ids]),
        "warnings": table("warning string, language string, grade_category string",
                          ("eqeqeq", "JavaScript", "Robust")),
        "gazetteer": table(GAZETTEER, ("Moscow", "city", "Moscow", "Russian Federation", 1)),
        "files": table(
            "repo_id string, repo_name string, login string, path string, size bigint, content string",
            *[(i, n, "target", p, 9, c) for n, i in ids.items()
              for p, c in (("./package.json", manifest), ("./a.js", "a\nb\nc\nd\n"))],
            (ids["owned2"], "owned2", "target", "./a b.js", 9, "x")),
        "findings": table("repo_id string, language string, rule string",
                          (ids["found"], "JavaScript", "eqeqeq"), ("nobody", "JavaScript", "eqeqeq")),
    }
    for name, rows in inputs.items():
        rows.write.parquet(str(tmp_path / "tables" / name))
    folders = {k: str(tmp_path / k) for k in ("pages", "tables", "store", "checkpoint")}
    options = parse([x for k, v in folders.items() for x in (f"--{k}", v)] + ["--once"])
    start(spark, options).awaitTermination()

    def stored(name):
        return changes.read_stored(spark, folders["store"], name)

    robust = stored("grades").filter("category = 'Robust'").select("raw_id", "value")
    assert rows_of(robust) == sorted([(ids["found"], 0.75), (ids["owned"], 1.0)])
    assert rows_of(stored("technologies")) == [
        ("JavaScript", "react", False), ("JavaScript", "react-dom", True)]
    assert {r.lines_of_code for r in stored("repositories").collect()} == {4}
    assert rows_of(stored("users").select("login", "full_name")) == [("target", "")]


def test_tables_by_name(spark, table, tmp_path):
    rows = table("k int", (1,), (2,))
    rows.write.parquet(str(tmp_path / "numbers"))
    assert rows_of(read_table(spark, "numbers", str(tmp_path))) == [(1,), (2,)]
    rows.createOrReplaceTempView("numbers_view")
    assert rows_of(read_table(spark, "numbers_view")) == [(1,), (2,)]
    assert rows_of(read_query(spark, "SELECT max(k) FROM {t}", {"t": rows})) == [(2,)]
