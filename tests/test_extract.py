import base64
import datetime
import json

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from skilltide.functions.ids import decode_owner_id
from skilltide.functions.numbers import commit_ratio
from skilltide.operators import extract as ex
from skilltide.plans.candidates import CandidateRules, enrich_users, extract_candidates
from skilltide.sources import pages as pg

RULES = CandidateRules(languages=("JavaScript", "Python"))


def as_of():
    return F.lit("2020-06-01").cast("date")


def b64(text):
    return base64.b64encode(text.encode()).decode()


def repo(name, owner, created="2019-01-01", pushed="2020-01-01", language="JavaScript", **extra):
    return {
        "id": b64(name), "name": name, "createdAt": created + "T10:00:00Z",
        "pushedAt": pushed + "T10:00:00Z",
        "primaryLanguage": language and {"name": language},
        "languages": {"nodes": [{"name": "HTML"}]}, "defaultBranchRef": {"name": "master"},
        "owner": {"id": owner}, "isFork": False, "isMirror": False, **extra,
    }


def node(name, login, owner, pinned=(), owned=(), **extra):
    found = repo(name, owner, **extra)
    found["owner"] = {"id": owner, "login": login, "pinnedRepositories": {"nodes": list(pinned)},
                      "repositories": {"nodes": list(owned)}}
    return found


USER = b64("04:User6502401")


@pytest.fixture
def pages(table):
    target = node(
        "found", "target", USER,
        pinned=[repo("pinned", USER), repo("found", USER), repo("others", b64("04:User7"))],
        owned=[repo("owned", USER), repo("fork", USER, isFork=True), repo("mirror", USER, isMirror=True),
               repo("young", USER, created="2019-12-01", pushed="2020-01-01"),
               repo("perl", USER, language="Perl"), repo("none", USER, language=None)])
    company = node("x", "company", b64("012:Organization5"), owned=[repo("y", b64("012:Organization5"))])
    single = node("only", "single", b64("04:User9"))
    texts = [{"nodes": [target, company]}, {"nodes": [single]}, {"nodes": []}, {"nodes": None}]
    return table("value string", *[(json.dumps(t),) for t in texts], ("{broken",))


@pytest.fixture
def analysed(table):
    return table("raw_id string, updated_by_analyzer timestamp_ntz",
                 (b64("owned"), datetime.datetime(1970, 1, 1)))


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_candidates(pages, analysed):
    found = extract_candidates(pages, analysed, RULES, as_of())
    assert names(found) == ["found", "owned", "pinned"]
    assert {(r.owner_id, r.owner_login) for r in found.collect()} == {(6502401, "target")}


def test_recently_analysed_is_dropped(pages, table):
    today = table("raw_id string, updated_by_analyzer timestamp_ntz",
                  (b64("owned"), datetime.datetime(2020, 5, 25)))
    assert names(extract_candidates(pages, today, RULES, as_of())) == ["found", "pinned"]


def test_one_pass_equals_union(pages):
    nodes = pg.parse_pages(pages)
    union = ex.found_repositories(nodes).unionByName(
        ex.owner_repositories(nodes, "pinnedRepositories")).unionByName(
        ex.owner_repositories(nodes, "repositories"))
    assert rows_of(ex.all_repositories(nodes)) == rows_of(union)


def test_broken_pages_are_kept_apart(pages):
    assert rows_of(pg.corrupt_pages(pages)) == [("{broken",)]


def test_owner_ids(table):
    ids = [b64("04:User12"), b64("012:Organization3"), b64("nothing"), "no base64!", b64("04:User"),
           b64("04:User99999999999999999999"), None]
    decoded = table("id int, x string", *enumerate(ids)).select(
        "id", decode_owner_id(F.col("x")).alias("d")).select("id", "d.*")
    assert rows_of(decoded) == [
        (0, "User", 12), (1, "Organization", 3), *[(i, "Unknown", -1) for i in range(2, 7)]]


@pytest.mark.parametrize("owner, everyone, ratio", [
    ([0, 1], [1, 9], 0.1), ([0, 8], [1, 9], 0.8), ([0], [0], None), (None, [1], 0.0),
    ([1, None], [2, None], 0.5), ([], [], None)])
def test_commit_ratio(table, owner, everyone, ratio):
    df = table("o array<bigint>, a array<bigint>", (owner, everyone))
    assert df.select(commit_ratio(F.col("o"), F.col("a"))).first()[0] == ratio


def enriched(pages, analysed, table, **ratios):
    weeks = table("owner_login string, name string, owner_commits bigint, all_commits bigint",
                  *[("target", n, week, 5) for n, r in ratios.items() for week in r])
    profiles = table(
        "requested_id bigint, id bigint, full_name string, description string, location string, "
        "company string, email string, blog string, job_seeker boolean",
        (6502401, 6502401, "T T", "bio", "Moscow", "c", None, "", True))
    return enrich_users(extract_candidates(pages, analysed, RULES, as_of()), profiles, weeks, RULES)


def test_enriched_users(pages, analysed, table):
    result = enriched(pages, analysed, table, found=[4, 5], owned=[4, 4], pinned=[1, 0])
    assert names(result.repositories) == ["found", "owned"]
    user = result.users.first()
    assert (user.full_name, user.blog, user.email, user.job_seeker) == ("T T", None, None, True)
    url = {r.name: r.archive_url for r in result.repositories.collect()}["found"]
    assert url == "https://github.com/target/found/archive/master.tar.gz"


def test_too_few_repositories_left(pages, analysed, table):
    result = enriched(pages, analysed, table, found=[4, 5], owned=[1, 1], pinned=[1, 0])
    assert result.repositories.count() == 0 and result.users.count() == 0


def test_profile_of_another_user_is_not_believed(table):
    users = table("owner_id bigint, owner_login string", (1, "a"))
    profiles = table(
        "requested_id bigint, id bigint, full_name string, description string, location string, "
        "company string, email string, blog string, job_seeker boolean",
        (1, 2, "n", "d", "l", "c", "e", "b", True))
    row = ex.attach_profiles(users, profiles).first()
    assert row.owner_login == "a" and row.full_name is None and row.job_seeker is None


def test_contacts_and_languages(table):
    users = table("user_id bigint, email string, blog string", (1, "e", "b"), (2, None, "c"))
    assert rows_of(ex.contacts_of(users)) == [
        ("Email", "e", 1), ("Website", "b", 1), ("Website", "c", 2)]
    repos = table("languages array<string>, primary_language string", (["Perl"], "C"), (None, "C"))
    assert rows_of(ex.languages_of(repos)) == [("C",), ("Perl",)]


def test_router(table):
    page = {"pageInfo": {"endCursor": "c", "hasNextPage": True}, "nodes": []}
    last = {"pageInfo": {"endCursor": "c", "hasNextPage": False}, "nodes": []}
    responses = table("value string", (json.dumps({"data": {"search": page}}),),
                      (json.dumps({"data": {"search": last}, "errors": [1]}),),
                      (json.dumps({"data": None, "errors": [{"message": "m"}]}),), ("{}",))
    routed = pg.route_pages(responses)
    cursors = routed.results.select(pg.next_cursor(pg.page_struct(F.col("value"))))
    assert sorted(str(r[0]) for r in cursors.collect()) == ["None", "c"]
    assert rows_of(routed.errors) == [('[{"message":"m"}]',)]
    assert routed.failures.count() == 1
