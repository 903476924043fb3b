from hypothesis import HealthCheck, given, settings, strategies as st

from conftest import rows_of
from skilltide.operators.synonyms import synonym_flags, technology_synonyms

T = "language string, technology string, position int"


def synonyms(table, names, language="JavaScript", **options):
    df = table(T, *[(language, n, i) for i, n in enumerate(names)])
    return [(stem, synonym) for _, stem, synonym in rows_of(technology_synonyms(df, **options))]


def test_variant_of_a_name(table):
    assert synonyms(table, ["eslint-plugin-better", "eslint", "nodemon"]) == [
        ("eslint", "eslint-plugin-better"), ("eslint", None), ("nodemon", None)]


def test_language_without_package_manager(table):
    assert synonyms(table, ["STL", "OpenCL", "OpenCL-extensions"], "C++") == [
        ("OpenCL", None), ("OpenCL-extensions", None), ("STL", None)]


def test_a_name_without_delimiter_is_no_variant(table):
    names = ["eslint-plugin-better", "eslint", "preact", "eslint_d", "react-dom", "react"]
    assert synonyms(table, names) == [
        ("eslint", "eslint-plugin-better"), ("eslint", "eslint_d"), ("eslint", None),
        ("preact", None), ("react", "react-dom"), ("react", None)]


def test_short_names_are_no_stems(table):
    assert synonyms(table, ["vue", "vue-router"]) == [("vue", None), ("vue-router", None)]


def test_items_beyond_the_limit_stay_stems(table):
    assert synonyms(table, ["eslint", "a-b-c", "eslint-x"], max_items=2) == [
        ("a-b-c", None), ("eslint", None), ("eslint-x", None)]


def test_repeated_name(table):
    names = ["eslint-x", "eslint-x", "eslint"]
    assert synonyms(table, names) == [("eslint", "eslint-x"), ("eslint", None)]
    assert synonyms(table, ["abc-x", "abc-x"]) == [("abc-x", None)]
    assert synonyms(table, ["abc-x", "abc-x"], distinct_input=False) == [
        ("abc-x", "abc-x"), ("abc-x", None)]


def test_flags(table):
    df = technology_synonyms(table(T, ("JavaScript", "eslint", 0), ("JavaScript", "eslint-x", 1)))
    assert rows_of(synonym_flags(df)) == [
        ("JavaScript", "eslint", False), ("JavaScript", "eslint-x", True)]


def shortest_first(names):
    """Brute force: the shortest name left claims what contains it and has a delimiter."""
    left = sorted((n for n in names if len(n) >= 4), key=lambda n: (len(n), names.index(n)))
    pairs = {(n, None) for n in names if len(n) < 4}
    while left:
        stem = left.pop(0)
        claimed = [n for n in left if stem in n and set(n) & set("-_.")]
        left = [n for n in left if n not in claimed]
        pairs |= {(stem, None)} | {(stem, n) for n in claimed}
    return sorted(pairs, key=str)


@settings(max_examples=20, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab-.", min_size=1, max_size=9), max_size=25, unique=True))
def test_against_brute_force(table, names):
    if names:
        assert synonyms(table, names) == shortest_first(names)
