import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import rows_of
from skilltide.operators import merge
from skilltide.plans.persisting import ROWS, RULES, Batch, merge_table, persist
from skilltide.schemas import TABLES

T = "k int, a string, b string"


def test_insert_ignore(table):
    merged = merge.insert_ignore(table(T, (1, "x", "y")), table(T, (1, "n", "n"), (2, "q", "r"),
                                                              (2, "p", "z")), ["k"])
    assert rows_of(merged) == [(1, "x", "y"), (2, "p", "z")]


def test_upsert_changes_only_named_columns(table):
    merged = merge.upsert(table(T, (1, "x", "y"), (3, "u", "v")),
                          table(T, (1, "n", None), (2, "q", "r")), ["k"], ["b"])
    assert rows_of(merged) == [(1, "x", None), (2, "q", "r"), (3, "u", "v")]


def test_flag_stays_true(table):
    schema = "k int, f boolean"
    merged = merge.upsert_flag_or(table(schema, (1, True), (2, False)),
                                  table(schema, (1, False), (2, True), (3, False)), ["k"], "f")
    assert rows_of(merged) == [(1, True), (2, True), (3, False)]


def test_delete_and_state(table):
    kept = merge.delete_where(table(T, (1, "x", "y"), (2, None, "y")), F.col("a") == "x")
    assert rows_of(kept) == [(2, None, "y")]
    state = table("key string, value string", ("query_index", "-1"), ("other", "o"))
    assert rows_of(merge.set_state(state, "query_index", "4")) == [
        ("other", "o"), ("query_index", "4")]


pairs = st.lists(st.tuples(st.integers(0, 4), st.sampled_from("abc"), st.sampled_from("xyz")),
                 max_size=8)


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(stored=pairs, batch=pairs)
def test_merges_are_idempotent(table, stored, batch):
    unique = list({k: (k, a, b) for k, a, b in stored}.values())
    target, rows = table(T, *unique), table(T, *batch)
    for once in (lambda t: merge.insert_ignore(t, rows, ["k"]),
                 lambda t: merge.upsert(t, rows, ["k"], ["b"])):
        first = once(target)
        assert rows_of(once(first)) == rows_of(first)
        assert first.count() == first.select("k").distinct().count()


USERS = ("user_id bigint, login string, full_name string, description string, location string, "
         "company string, email string, blog string, job_seeker boolean")


def batch_of(table, technologies):
    return Batch(
        users=table(USERS, (1, "a", "A A", "d", "SPB", None, "a@x", "a.x", True),
                    (2, "b", None, None, None, None, None, "a.x", None)),
        repositories=table(
            "user_id bigint, raw_id string, primary_language string, languages array<string>",
            (1, "r1", "JavaScript", ["C++", "Perl"]), (2, "r2", "JavaScript", None)),
        grades=table("raw_id string, name string, grade_category string, value double, "
                     "lines_of_code bigint", ("r1", "n1", "Robust", 0.5, 10)),
        technologies=table("raw_id string, language string, technology string",
                           *[("r1", "JavaScript", t) for t in technologies]),
        locations=table("user_id bigint, country string, city string",
                        (1, "Russian Federation", "Saint Petersburg"),
                        (2, None, "Saint Petersburg")),
    )


@pytest.fixture
def empty(spark):
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


def now():
    return F.lit("2024-01-01 00:00:00")


def test_persist_fills_all_tables(table, empty):
    stored = persist(batch_of(table, ["eslint", "eslint-plugin-better"]), empty, now())
    assert rows_of(stored["languages"]) == [("C++",), ("JavaScript",), ("Perl",)]
    assert rows_of(stored["countries"]) == [("Russian Federation",)]
    assert rows_of(stored["cities"]) == [("Saint Petersburg",)]
    assert rows_of(stored["users"].select("user_id", "login", "full_name")) == [
        (1, "a", "A A"), (2, "b", "")]
    assert rows_of(stored["developers"].select(
        "user_id", "job_seeker", "description", "country", "city")) == [
        (1, True, "d", "Russian Federation", "Saint Petersburg"),
        (2, False, "", None, "Saint Petersburg")]
    # both users name one website: the first keeps it
    assert rows_of(stored["contacts"]) == [("Email", "a@x", 1), ("Website", "a.x", 1)]
    assert rows_of(stored["technologies"]) == [
        ("JavaScript", "eslint", False), ("JavaScript", "eslint-plugin-better", True)]
    assert stored["technologies_users"].count() == 2
    assert {r.verified for r in stored["technologies_users_settings"].collect()} == {True}
    assert rows_of(stored["repositories"].select("raw_id", "user_id", "name", "lines_of_code")) == [
        ("r1", 1, "n1", 10)]
    assert rows_of(stored["grades"]) == [("Robust", "r1", 0.5)]


@pytest.mark.parametrize("first, second", [
    (["eslint-plugin-better"], ["eslint-plugin-better", "eslint"]),
    (["eslint-plugin-better", "eslint"], ["eslint-plugin-better"])])
def test_synonym_flag_over_batches(table, empty, first, second):
    stored = empty["technologies"]
    for names in (first, second):
        stored = merge_table("technologies", stored,
                             ROWS["technologies"](batch_of(table, names), now()))
    assert dict((r.technology, r.synonym) for r in stored.collect())["eslint-plugin-better"]


def test_later_run_refreshes_only_some_columns(table, empty):
    once = persist(batch_of(table, ["eslint"]), empty, now())
    later = batch_of(table, ["eslint"])
    users = later.users.withColumns({"login": F.lit("new"), "description": F.lit("new")})
    grades = later.grades.withColumns({"value": F.lit(0.9), "name": F.lit("new"),
                                       "lines_of_code": F.lit(99).cast("long")})
    twice = persist(later._replace(users=users, grades=grades), once, F.lit("2025-01-01"))
    assert {r.login for r in twice["users"].collect()} == {"new"}
    assert {r.description for r in twice["developers"].collect()} == {"d", ""}
    repo = twice["repositories"].first()
    assert (repo.name, repo.lines_of_code, repo.updated_by_analyzer.year) == ("n1", 99, 2025)
    assert twice["grades"].first().value == 0.9


def test_rules_cover_all_tables():
    assert set(RULES) == set(TABLES) == set(ROWS)
