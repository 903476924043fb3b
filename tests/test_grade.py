import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from skilltide.functions.fixed import GRADE_CATEGORIES
from skilltide.operators import grade as g
from skilltide.operators.lists import sorted_lists
from skilltide.plans.grading import grade, graded_with_technologies
from skilltide.schemas import MESSAGE
from skilltide.sources.records import format_worklist, parse_records

CATALOG = "warning string, language string, grade_category string"


def message(language, kind, text, repo="r1"):
    return (repo, "name-" + repo, language, kind, text)


def lines(repo="r1", **languages):
    return [message(k, "lines_of_code", str(v), repo) for k, v in languages.items()]


@pytest.fixture
def catalog(table):
    return table(CATALOG, ("eqeqeq", "JavaScript", "Robust"), ("complexity", "JavaScript", "Robust"),
                 ("complexity", "JavaScript", "Maintainable"))


def grades(table, catalog, *rows):
    graded = grade(table(MESSAGE, *rows), catalog).collect()
    return {r.grade_category: round(r.value, 6) for r in graded}, graded


def test_lines_add_up_over_languages(table, catalog):
    rows = lines(C=91, JavaScript=140) + [message("C++", "lines_of_code", "961")]
    values, graded = grades(table, catalog, *rows)
    assert {r.lines_of_code for r in graded} == {1192}
    assert sorted(values) == sorted(GRADE_CATEGORIES)


def test_no_tools_and_no_tests(table, catalog):
    rows = lines(JavaScript=100) + [message("JavaScript", "warning", "eqeqeq")] * 3 + [
        message("all_languages", "tests_dir_exists", "False")]
    values, _ = grades(table, catalog, *rows)
    assert values == {"Robust": 0.97, "Automated": 0.0, "Testable": 0.0, "Performant": 1.0,
                      "Secure": 1.0, "Maintainable": 1.0}


@pytest.mark.parametrize("tools, value", [(1, 0.333333), (2, 0.666667), (3, 1.0), (5, 1.0)])
def test_tools(table, catalog, tools, value):
    rows = lines(JavaScript=10) + [
        message("all_languages", "automation_tool", f"t{i}") for i in range(tools)]
    assert grades(table, catalog, *rows)[0]["Automated"] == value


def test_tests_dir(table, catalog):
    rows = lines(JavaScript=10) + [message("all_languages", "tests_dir_exists", "True")]
    assert grades(table, catalog, *rows)[0]["Testable"] == 1.0


def test_warning_of_two_categories_and_unknown_warning(table, catalog):
    rows = lines(JavaScript=10) + [message("JavaScript", "warning", "complexity"),
                                   message("JavaScript", "warning", "never-heard-of")]
    values, _ = grades(table, catalog, *rows)
    assert (values["Robust"], values["Maintainable"], values["Secure"]) == (0.9, 0.9, 1.0)


def test_empty_language_counts_as_zero_unless_skipped(table, catalog):
    rows = lines(JavaScript=10, C=0)
    assert grades(table, catalog, *rows)[0]["Secure"] == 0.5
    skipped = grade(table(MESSAGE, *rows), catalog, skip_empty_languages=True)
    assert {r.value for r in skipped.collect() if r.grade_category == "Secure"} == {1.0}


def test_more_warnings_than_lines(table, catalog):
    rows = lines(JavaScript=2) + [message("JavaScript", "warning", "eqeqeq")] * 5
    assert grades(table, catalog, *rows)[0]["Robust"] == 0.0


def test_repository_without_dependencies_has_no_display_row(table, catalog):
    rows = lines(JavaScript=10) + lines("r2", JavaScript=5) + [
        message("JavaScript", "dependence", "react"), message("JavaScript", "dependence", "react"),
        message("C", "dependence", "libc")]
    messages = table(MESSAGE, *rows)
    shown = graded_with_technologies(grade(messages, catalog), messages).collect()
    assert sorted(str(r.language_to_technologies) for r in shown) == [
        "{'C': ['libc']}", "{'JavaScript': ['react']}"]
    assert {r.repo_id for r in shown} == {"r1"}
    assert all(len(r.grades) == 6 for r in shown)


def test_repository_without_lines_has_only_penalties(table, catalog):
    values, _ = grades(table, catalog, message("all_languages", "tests_dir_exists", "True"))
    assert values == {"Automated": 0.0, "Testable": 0.0}


def test_categories_must_hold_the_penalised_ones(table, catalog):
    with pytest.raises(ValueError):
        grade(table(MESSAGE, *lines(C=1)), catalog, ["Robust"])


def test_zero_filled_counts_cover_all_languages(table, catalog):
    messages = table(MESSAGE, message("all_languages", "tests_dir_exists", "True"),
                     message("JavaScript", "warning", "eqeqeq"))
    counts = rows_of(g.warning_counts(messages, catalog).select(
        "language", "grade_category", "warnings").filter("warnings > 0"))
    assert counts == [("JavaScript", "Robust", 1)]
    assert g.warning_counts(messages, catalog).count() == 12


def test_merge_maps(table):
    maps = table("id int, m map<string, array<string>>",
                 (1, {"k1": ["v1", "v2"], "k2": ["v3", "v4"]}), (1, {"k1": ["v3"], "k3": []}))
    merged = g.collect_map(g.merge_maps(maps, ["id"], "m"), ["id"]).collect()
    assert {r.key: r["values"] for r in merged} == {
        "k1": ["v1", "v2", "v3"], "k2": ["v3", "v4"], "k3": []}


def test_lists_have_one_row_per_group_of_any_size(table):
    rows = [(1, i % 20_000) for i in range(20_050)] + [(2, 7)]
    got = {r.k: r.vs for r in sorted_lists(table("k int, v int", *rows), ["k"], F.col("v"), "vs").collect()}
    assert got == {1: sorted(v for k, v in rows if k == 1), 2: [7]}


def test_records(table):
    rows = parse_records(table("value string", ("a;b;c;d;e",), ("a;b;c;d;",), ("a;b;c;d;e;",),
                               ("a;b;c;d;e;f",), ("a;;c;d;e",), ("",)))
    assert rows_of(rows) == [("a", "", "c", "d", "e"), ("a", "b", "c", "d", "e"),
                             ("a", "b", "c", "d", "e")]


def test_worklist(table):
    row = format_worklist(table(
        "repo_id string, name string, owner_login string, archive_url string, "
        "languages array<string>, primary_language string", ("i", "n", "l", "u", ["C", "Go"], "Go")))
    assert row.first()["value"] == "i;n;l;u;C,Go"
