"""Costly steps are made once, whatever reads them."""

import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from checks import files as checked
from conftest import rows_of
from skilltide.operators import search as s
from skilltide.plans import ranking, searching
from skilltide.plans.candidates import CandidateRules, enrich_users, extract_candidates
from skilltide.sources.pages import parsed_pages


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


PAGE = ('{"nodes": [{"id": "r%d", "name": "n%d", "createdAt": "2000-01-01T00:00:00Z", "pushedAt": '
        '"2001-01-01T00:00:00Z", "primaryLanguage": {"name": "C"}, "owner": {"id": "MDQ6VXNlcjc=", "login": "me"}}]}')


def test_pages_are_parsed_once_for_users_and_repositories(spark, table):
    pages = table("value string", *[(PAGE % (i, i),) for i in (1, 2)])
    analysed = table("raw_id string, updated_by_analyzer timestamp_ntz")
    profiles = table("requested_id long, id long, full_name string, description string, location string, "
                     "company string, email string, blog string, job_seeker boolean")
    weeks = table("owner_login string, name string, owner_commits long, all_commits long",
                  ("me", "n1", 9, 10), ("me", "n2", 8, 10))
    rules = CandidateRules(languages=("C",))
    repos = extract_candidates(pages, analysed, rules, F.lit("2020-01-01").cast("date"))
    users, owned = enrich_users(repos, profiles, weeks, rules)
    assert rows_of(owned.select("owner_id", "repo_id", "owner_ratio")) == [(7, "r1", 0.9), (7, "r2", 0.8)]
    assert rows_of(users.select("owner_id", "owner_login")) == [(7, "me")]
    for df in (repos, users, owned):
        assert "from_json" not in plan(df)


def test_a_page_is_not_parsed_again_for_errors(table):
    pages = table("value string", (PAGE % (1, 1),), ('{"errors": "no"',))
    parsed = parsed_pages(pages)
    assert "get_json_object" not in plan(parsed)
    assert sorted(r["kind"] for r in parsed.collect()) == ["broken", "node"]


@pytest.fixture
def tables(table):
    """Users 1 to 4; only the last has red-bolt, blue and c."""
    used = [(u, lang, tech) for u, lang, tech in (
        (1, "c", "red-bolt"), (2, "java", "red-bolt"), (2, "java", "blue"), (3, "c", "blue"), (4, "c", "red-bolt"),
        (4, "c", "blue"), (4, "java", "blue"))]
    return {
        ranking.VERIFIED: table("user_id long, language string, technology string", *used),
        "repositories": table("raw_id string, user_id long, name string, lines_of_code long, updated_by_analyzer string",
                              *[(f"r{u}", u, "n", 1, "2024") for u in (1, 2, 3, 4)]),
        "grades": table("category string, raw_id string, value double", *[("A", f"r{u}", u / 8) for u in (1, 2, 3, 4)]),
        "users": table("user_id long, login string, full_name string", *[(u, f"u{u}", "") for u in (1, 2, 3, 4)]),
        "languages": table("language string", ("c",), ("java",)),
        "technologies": table("language string, technology string", ("c", "red-bolt"), ("c", "blue")),
    }


def test_verified_technologies_are_taken_from_their_table(table, tables):
    """Ranking, batches of the standings and the index do without the tables it was made from."""
    assert ranking.figures(tables).count() == 4
    assert rows_of(ranking.figures(tables, table("user_id long", (2,), (9,))).select("user_id")) == [(2,)]
    index = searching.search_index(tables, ranking.rank_users(tables))
    assert index.postings.filter("token = 'blue'").count() == 3


def test_with_verified_stores_them(table):
    given = {"technologies_users": table("user_id long, language string, technology string", (1, "c", "x"), (2, "c", "x")),
             "technologies_users_settings": table("user_id long, language string, technology string, verified boolean",
                                                  (1, "c", "x", True), (2, "c", "x", False)),
             "developers": table("user_id long", (1,), (2,))}
    rows = ranking.with_verified(given)[ranking.VERIFIED]
    assert rows_of(rows) == [(1, "c", "x")] and "Join" not in plan(rows)


def test_several_names_meet_only_their_own_postings(table, tables):
    queries = table("query_id string, text string, page int", ("both", "red-bolt blue", 1), ("all", "blue red-bolt c", 1),
                    ("java", "java red-bolt", 1), ("one", "blue", 1))
    ranks = ranking.rank_users(tables)
    index = searching.search_index(tables, ranks)
    found = searching.search(queries, ranks, index, tables)
    assert rows_of(found.select("query_id", "user_id")) == [
        ("all", 4), ("both", 2), ("both", 4), ("java", 2), ("java", 4), ("one", 2), ("one", 3), ("one", 4)]
    names = F.array(*[F.struct(F.lit("technology").alias("token_type"), F.lit(x).alias("lexeme"))
                      for x in ("red-bolt", "blue")])
    sets = table("key string, need int", ("k", 20)).withColumn("names", names)
    best = s.best_by_names(sets, index)
    assert best.count() == 2 and "count(distinct" not in plan(best)


def test_package_files_are_made_once(table, monkeypatch):
    class Given:
        @property
        def package_files(self):
            rows = table("repo_id string, n int", ("a", 1), ("a", 2))
            return rows.withColumn("copy", F.row_number().over(Window.partitionBy("repo_id").orderBy("n")))

        def values(self, rows, schema):
            return table(schema, *rows)

    monkeypatch.setattr(checked, "analyse", lambda files, repositories, findings: (files, repositories))
    files, repositories = checked.assemble_messages(Given())
    assert files.count() == 2 and repositories.count() == 1
    assert "Window" not in plan(files) and "Window" not in plan(repositories)


def test_buckets_of_one_smallest_member_are_verified_together():
    """1 meets 2 in bucket 10 and 3 in bucket 11; 2 and 3 are alike but meet in no bucket of theirs."""
    from skilltide.llm.jaccard import _verifier
    one = [list(range(10))] * 3
    rows = pd.DataFrame({"member": [1, 2, 3], "weight": [1, 1, 1], "block": 0, "part_a": 0, "part_b": 0, "head": 1,
                         "here": [[10, 11], [10], [11]], "shingles": one, "buckets": [[10, 11], [10], [11]]})
    out = pd.concat(_verifier(0.8)(iter([rows])))
    assert sorted(map(tuple, out.to_numpy().tolist())) == [(1, 2, 1), (2, 1, 1), (3, 1, 1)]
