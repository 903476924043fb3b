import datetime
import json
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import rows_of
from skilltide.functions.fixed import TOKEN_TYPES
from skilltide.functions.text import extract_lexemes
from skilltide.operators import ranked, search as op, tokens as t
from skilltide.operators.locations import GAZETTEER, resolve_location
from skilltide.operators.names import match_names, match_prefixes
from skilltide.plans import ranking, searching
from skilltide.schemas import TABLES


@pytest.fixture
def gazetteer(table):
    return table(
        GAZETTEER,
        ("Saint Petersburg", "city", "Saint Petersburg", "Russian Federation", 5_000_000),
        ("Saint Petersburg", "city", "Saint Petersburg", "United States", 250_000),
        ("Russia", "country", None, "Russian Federation", 0),
        ("Russian Federation", "country", None, "Russian Federation", 0),
        ("United States", "country", None, "United States", 0),
        ("CA", "state", None, "United States", 0))


@pytest.fixture
def tables(spark):
    """Three users, two of them developers."""
    day = datetime.datetime(2020, 1, 1)
    synonyms = {"jboss-foobar"}
    technologies = [("Java", n) for n in ("jaafoobar", "jni", "jboss", "jboss-foobar")]
    technologies += [("JavaScript", "jade"), ("Python", "pygtk")]
    technologies += [("JavaScript", f"s-foo-bar-{i}") for i in range(1, 12)]
    used = [("JavaScript", "jade", 1, True), ("Java", "jboss", 2, True),
            ("JavaScript", "s-foo-bar-1", 2, True), ("Python", "pygtk", 2, False),
            ("JavaScript", "s-foo-bar-2", 2, False)]
    rows = {
        "languages": [(x,) for x in ("JavaScript", "Java", "C", "C++", "Python")],
        "technologies": [(lang, n, n in synonyms) for lang, n in technologies],
        "countries": [("Russian Federation",), ("Japan",)],
        "cities": [("Saint Petersburg",), ("Moscow",), ("Joetsu",)],
        "users": [(1, "userA", "A A", None), (2, "userB", "B B", None), (3, "userC", "C C", None)],
        "developers": [(i, None, False, None, None, None, "", "", None, None, 0) for i in (1, 2)],
        "contacts": [("Email", "a@x", 1)],
        "technologies_users": [u[:3] for u in used],
        "technologies_users_settings": used,
        "repositories": [("foo_id", 1, "bar", 12345, day), ("hello_id", 2, "hello_world", 777, day)],
        "grades": [("Secure", "foo_id", 0.8), ("Testable", "hello_id", 0.5),
                   ("Secure", "hello_id", 1.0)],
    }
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in TABLES.items()}


@pytest.mark.parametrize("text, words", [
    ("", []), (" ", []), ("C++ Developers", ["c++", "developers"]),
    ("  c++  python linux", ["c++", "python", "linux"]), ("… ... ;", ["…", ".", ";"]),
    ('c/c++, js\\javascript,,, "hello world" perl. node.js eslint_d',
     ["c", "c++", "js", "javascript", "hello", "world", "perl", "node.js", "eslint_d"]),
    (" ".join(map(str, range(1005))) + "  ", [str(i) for i in range(5, 1005)])])
def test_lexemes(table, text, words):
    got = table("text string", (text,)).select(extract_lexemes(F.col("text"), 1000)).first()[0]
    assert got == words


@pytest.mark.parametrize("text, place", [
    ("", (None, None)), ("Saint Petersburg, Russia", ("Russian Federation", "Saint Petersburg")),
    ("Russia", ("Russian Federation", None)), ("CA", ("United States", None)),
    ("nowhere at all", (None, None))])
def test_places(table, gazetteer, text, place):
    row = resolve_location(table("id int, text string", (1, text)), ["id"], "text", gazetteer).first()
    assert (row.country, row.city) == place


def queries(table, *texts, page=1):
    return table("query_id string, text string, page int", *[(x, x, page) for x in texts])


def test_tokens(table, tables, gazetteer):
    texts = ["in", "javascript python", "jade jboss", "USERB",
             "saint petersburg russian federation united states", ""]
    asked = queries(table, *texts)
    found = searching.tokenize(asked, tables, gazetteer)
    assert rows_of(found) == sorted([
        ("in", "stopWord", "in"), ("javascript python", "language", "javascript"),
        ("javascript python", "language", "python"), ("jade jboss", "technology", "jade"),
        ("jade jboss", "technology", "jboss"), ("USERB", "githubLogin", "userb"),
        (texts[4], "city", "Saint Petersburg"), (texts[4], "country", "Russian Federation")], key=str)
    maps = {r.query_id: r.tokens for r in t.token_map(asked, found).collect()}
    assert all(sorted(m) == sorted(TOKEN_TYPES) for m in maps.values()) and len(maps) == 6
    assert maps[""] == {k: [] for k in TOKEN_TYPES}


def test_live_wildcards(table):
    names = table("name string", ("eslint_d",), ("ESLINT-d",), ("eslint",), ("ab",))
    patterns = table("lexeme string", ("eslint_d",), ("%nt",), ("__",), ("%",), ("x%",))
    pairs = rows_of(match_names(patterns, names).select("lexeme", "name"))
    assert pairs == sorted([("eslint_d", "eslint_d"), ("eslint_d", "ESLINT-d"), ("%nt", "eslint"),
                            ("__", "ab"), *[("%", n) for n in ("eslint_d", "ESLINT-d", "eslint", "ab")]
                            ], key=str)
    escaped = rows_of(match_names(patterns, names, escape=True).select("lexeme", "name"))
    assert escaped == [("eslint_d", "eslint_d")]


WORDS = st.text("aAb_%\u00e9", max_size=5)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(WORDS, max_size=6), st.lists(st.text("aAb_-\u00e9", max_size=6), max_size=8))
def test_wildcards_against_every_pair(spark, patterns, names):
    """Runs at the start, in the middle, at the end and none at all; repeats and nulls."""
    left = spark.createDataFrame([(p,) for p in [*patterns, "a%b", "%a_%", None]], "lexeme string")
    right = spark.createDataFrame([(n,) for n in [*names, "aab", "aab", None]], "name string")
    every = [(p, n) for p, in left.collect() for n, in right.collect() if p is not None and n is not None]

    def like(pattern, name):
        rule = "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in pattern.lower())
        return re.fullmatch(rule, name.lower()) is not None

    assert rows_of(match_names(left, right)) == sorted([(p, n) for p, n in every if like(p, n)], key=str)
    assert rows_of(match_prefixes(left, right)) == sorted(
        [(p, n) for p, n in every if like(p + "%", n)], key=str)
    assert rows_of(match_prefixes(left, right, escape=True)) == sorted(
        [(p, n) for p, n in every if n.lower().startswith(p.lower())], key=str)


def search(table, tables, text, page=1, order="grade"):
    ranks = ranking.rank_users(tables, order)
    results = searching.search(queries(table, text, page=page), ranks, searching.search_index(tables, ranks), tables)
    return [r.user_id for r in results.orderBy("position").collect()], results, ranks


def test_search_by_language(table, tables):
    users, results, ranks = search(table, tables, "javascript", order="user_id")
    assert users == [2, 1]
    assert search(table, tables, "javascript")[0] == [1, 2]
    document = json.loads(searching.search_documents(results, ranks, tables).first()["json"])
    first = document["users"][0]
    assert first["githubLogin"] == "userB" and first["avgGrade"] == 0.75
    assert {"technology": "jboss", "verified": True} in first["technologies"]
    assert "pygtk" not in str(first)


@pytest.mark.parametrize("text, users", [
    ("javascript jade", [1]), ("jade jboss", []), ("jboss", [2]), ("java s-foo-bar-1", [2]),
    ("usera", [1, 2]), ("userb", [2, 1]), ("nothing known", [1, 2]), ("usera java", [1, 2]),
    ("s-foo-bar-1 usera", [1, 2]), ("userc", [1, 2]), ("c++", [])])
def test_search(table, tables, text, users):
    assert search(table, tables, text)[0] == users


def test_pages(table, tables):
    assert search(table, tables, "javascript", page=2)[0] == []
    ranks = ranking.rank_users(tables)
    asked = table("query_id string, text string, page int", ("a", "javascript", 2), ("b", "x", 2),
                  ("c", "userb", 1), ("d", "x", 9))
    results = searching.search(asked, ranks, searching.search_index(tables, ranks), tables, page_size=1)
    assert rows_of(results.select("query_id", "position", "user_id")) == [
        ("a", 2, 2), ("b", 2, 2), ("c", 1, 2)]


def suggest(table, tables, text, **options):
    found = searching.suggest(queries(table, text), tables, **options)
    return [r.suggestion for r in found.orderBy("pos").collect()]


def test_suggestions(table, tables):
    assert "java" in suggest(table, tables, "j")
    assert suggest(table, tables, "java j") == [
        f"java {x}" for x in ("jni", "jboss", "jaafoobar", "jade", "javascript", "japan", "joetsu",
                              "jboss-foobar")]
    assert len(suggest(table, tables, "s")) == 10
    assert suggest(table, tables, "  ") == [] and suggest(table, tables, "zzz") == []


def test_suggestions_with_live_wildcards(table, tables):
    assert suggest(table, tables, "_bos") == ["jboss", "jboss-foobar"]
    assert suggest(table, tables, "_bos", escape=True) == []


def test_suggestion_documents(table, tables):
    asked = queries(table, "moscow mos", "pyg", "zzz")
    found = searching.suggest(asked, tables)
    documents = {r.query_id: json.loads(r.json) for r in
                 searching.suggestion_documents(found, asked).collect()}
    assert documents == {"moscow mos": {"suggestions": []}, "pyg": {"suggestions": ["pygtk"]},
                         "zzz": {"suggestions": []}}


def test_user_pages(tables):
    page = {r.login: r for r in ranking.user_pages(tables).collect()}
    assert sorted(page) == ["userA", "userB"]
    assert page["userB"].avg_grade == 0.75 and page["userB"].updated.year == 2020
    assert [json.loads(c) for c in page["userA"].contacts] == [
        {"category": "Email", "contact": "a@x"}]
    assert [r.user_id for r in ranking.top_page(tables).collect()] == [1, 2]
    assert ranking.top_page(tables, page=2, page_size=1).first().user_id == 2


def test_global_row_number(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 3)
    numbered = ranked.global_row_number(df, [F.desc("v"), F.col("id")], "n", partitions=7)
    got = [(r.v, r.id) for r in numbered.orderBy("n").collect()]
    assert got == sorted(((i % 3, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    assert [r.n for r in numbered.orderBy("n").collect()] == list(range(1, 1001))


def test_top_n_cut_in_parts_is_exact(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), "id")
    top = ranked.top_n_per_group(df, ["k"], [F.desc("id")], F.lit(1100), salts=4)
    assert sorted(r.id for r in top.collect()) == list(range(800, 3000))


def test_resume(spark):
    df = spark.range(5)
    assert rows_of(ranked.resume_from(df, [F.col("id")], 2).select("index")) == [(3,), (4,)]
    assert ranked.resume_from(df, [F.col("id")], 4).count() == 5
    assert ranked.resume_from(df, [F.col("id")], -1).count() == 5
    assert ranked.resume_from(spark.range(0), [F.col("id")], 2).count() == 0


@pytest.mark.parametrize("block_ranks", [1, 3, 1000])
def test_pages_from_few_blocks(spark, table, block_ranks):
    """Random users and queries against a comparison of every query with every user."""
    rng = random.Random(block_ranks)
    kinds = {"language": ["java", "c", "go"], "technology": ["ab", "abc", "abd", "b-c", "x.y", "zz"]}
    users = {u: {k: set(rng.sample(v, rng.randint(0, 3))) for k, v in kinds.items()} for u in range(1, 41)}
    logins = {u: rng.choice([f"ann-{u}", "ann-lee", f"lee{u}", "ann_ann", f"bob.{u}"]) for u in users}
    verified = [(u, lang, tech) for u, x in users.items() for lang in x["language"] for tech in x["technology"]]
    seen = {u: ({lang for v, lang, _ in verified if v == u}, {t for v, _, t in verified if v == u}) for u in users}
    ranks = table("rank long, user_id long, login string", *[(41 - u, u, logins[u]) for u in users])
    asked = []
    for q in range(40):
        names = [("language", x) for x in rng.sample(kinds["language"], rng.choice([0, 0, 1, 2]))]
        names += [("technology", x) for x in rng.sample(["a", "ab", "b", "c", "x", "y", "zz", "q"], rng.choice([0, 1, 2]))]
        names += [("githubLogin", x) for x in rng.sample(["ann", "lee", "ann-lee", "bob", "none"], rng.choice([0, 0, 1, 2]))]
        asked.append((q, names, rng.randint(1, 3)))
    queries = table("query_id int, page int", *[(q, page) for q, _, page in asked])
    tokens = table("query_id int, token_type string, lexeme string", *[(q, *n) for q, names, _ in asked for n in names])
    index = op.build_index(table("user_id long, language string, technology string", *verified), ranks, block_ranks)
    got = rows_of(op.search_pages(queries, tokens, ranks, index, 4))

    def parts(text):
        return [t for w in [text] for t in ([w] if not re.search("[-_.]", w) else [w, *re.split("[-_.]", w)]) if t]

    want = []
    for q, names, page in asked:
        by = {k: [x for t, x in names if t == k] for k in ("language", "technology", "githubLogin")}
        found = []
        for u in users:
            words = parts(logins[u])
            score = sum(sum(1 / n ** 2 for n in range(1, words.count(x) + 1)) for x in by["githubLogin"])
            have = {t for x in seen[u][1] for t in parts(x)}
            named = (not by["language"] or seen[u][0] & set(by["language"])) and all(
                any(t.startswith(x) for t in have) for x in by["technology"])
            if score or named:
                found.append((round(score, 9), 41 - u, u))
        best = sorted(found, reverse=True)
        want += [(q, k + 1, u, int(score > 0), rank) for k, (score, rank, u) in enumerate(best)
                 if (page - 1) * 4 <= k < page * 4]
    assert got == sorted(want, key=str)


def test_words_of_logins(table, tables):
    users = table("user_id long, login string, full_name string, updated_by_user timestamp_ntz",
                  (1, "john", None, None), (2, "john-doe", None, None), (3, "doe", None, None))
    more = tables | {"users": users}
    assert search(table, more, "john")[0] == [1, 2]
    assert search(table, more, "john doe")[0] == [2, 1]
    found = search(table, more, "doe")[1].orderBy("position").collect()
    assert [(r.user_id, r.login_match) for r in found] == [(2, 1), (1, 0)]


@pytest.mark.parametrize("common", [0, 4, 1000])
def test_best_logins_against_every_login(spark, table, common):
    """Common words are looked up once for all sets that share them; the best are those of scoring everyone."""
    rng = random.Random(common)
    words = ["red", "blue", "ink", "jet", "kit"]
    logins = {rank: [w for w in words if rng.random() < 0.5] + rng.choices(words, k=rng.randrange(3)) + [f"u{rank}"]
              for rank in range(1, 61)}
    rows = [(w, rank, own.count(w)) for rank, own in logins.items() for w in set(own)]
    index = op.SearchIndex(None, None, table("token string, rank long, times long", *rows), 60)
    sets = [rng.sample(words, rng.randrange(3)) + rng.sample([f"u{i}" for i in range(70)], rng.randrange(1, 3))
            for _ in range(12)] + [["red"], ["red", "blue"], ["unknown"]]
    wanted = [(str(k), [("githubLogin", w) for w in s], rng.randrange(1, 9)) for k, s in enumerate(sets)]
    best = op.best_by_login(table(
        "key string, names array<struct<token_type: string, lexeme: string>>, need int", *wanted), index, common)

    def score(own, asked):
        return sum(sum(1 / n ** 2 for n in range(1, own.count(w) + 1)) for w in asked) / len(asked) / op.REPEATED

    expected = []
    for k, (names, need) in enumerate(w[1:] for w in wanted):
        all_scores = [(round(score(own, [w for _, w in names]), 9), rank) for rank, own in logins.items()]
        expected += [(str(k), rank, s) for s, rank in sorted(all_scores, reverse=True)[:need] if s > 0]
    assert rows_of(best.withColumn("score", F.round("score", 9))) == sorted(expected, key=str)


def test_repeated_names_are_matched_once(table):
    names = table("token_type string, name string, language string",
                  *[("githubLogin", "Ann", None)] * 50, ("technology", "ann", "C"), ("technology", "ann", "D"))
    found = t.named_tokens(table("query_id string, pos int, lexeme string", ("q", 0, "ann"), ("q", 1, "bob")), names)
    assert rows_of(found) == [("q", "githubLogin", "ann"), ("q", "technology", "ann"), ("q", "technology", "ann")]


def test_wildcard_logins_are_not_sorted_again(spark, table, tmp_path):
    """Customers that come twice give their pairs once, without comparing all pairs."""
    ids = [1, 1, 2, 90001, None]
    table("c_custkey long, c_name string", *[(i, f"Customer#{i or 0:09d}") for i in ids]).write.parquet(
        f"{tmp_path}/customer.parquet")
    table("s_name string", ("Supplier#000000001",)).write.parquet(f"{tmp_path}/supplier.parquet")
    found = entry.queries()["wildcard_login_join"](spark, str(tmp_path))
    rows = rows_of(found)
    assert len(rows) == len(set(rows)) and (1, "customer#%001", "customer#000090001") in rows
    assert found._jdf.queryExecution().optimizedPlan().nodeName() != "Aggregate"
