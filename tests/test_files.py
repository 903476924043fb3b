import random
import json

import pytest

import __spark_entry__ as entry
from conftest import rows_of
from skilltide.operators import files as f, manifests as m
from skilltide.plans.analysing import analyze_files
from skilltide.sources import files as sf, lint

T = "repo_id string, repo_name string, login string, path string, size bigint, content string"


@pytest.fixture
def tree(table):
    def make(*files, repo="r1", name="proj", login="me"):
        return table(T, *[(repo, name, login, p, len(c or ""), c) for p, c in files])
    return make


def test_lines(tree):
    files = tree(("./a.c", "int x;\n\n  \t\nint y;\r\nz"), ("./b.cpp", ""), ("./c.js", "\n a \n"),
                 ("./d.txt", "text"), ("./e.js", None))
    assert rows_of(f.lines_of_code(f.file_facts(files)).select("language", "lines_of_code")) == [
        ("C", 3), ("C++", 0), ("JavaScript", 1)]


@pytest.mark.parametrize("content, lines", [
    ("/* a\n b */\nint x; // y\n// only", 1),
    ('s = "// no";\nt = "/*";\nu;', 3),
    ("s = '\\'/*';\nt;\n/* */", 2),
    ("`/*\n*/`\n//", 2),
    ("a;\n/* open\nb;\n", 1),
    ("/*/ still\nb */ c;", 1),
    ("don't // stop\n/**/\n/***/ x /* **/", 2),
    ('"unpaired /*\nhidden */ y\nz', 2),
    ("/* x */" * 50_000 + "\ny", 1),
    ('"' + '\\"' * 200_000 + "\n// z\ny", 2),
    ("/" + "*" * 300_000, 0),
])
def test_comments(tree, content, lines):
    files = tree(("./a.c", content))
    assert rows_of(f.lines_of_code(f.file_facts(files)).select("lines_of_code")) == [(lines,)]


def test_commented_includes(tree):
    files = tree(("./a.c", "// #include <a.h>\n/* x\n#include <b.h>\n*/ #include <c.h>\n#include <d.h> // e"))
    assert rows_of(f.includes(f.file_facts(files)).select("header")) == [("c.h",), ("d.h",)]


def test_includes(tree, spark):
    files = tree(("./a.c", "#include <stdio.h> #include <time.h>\n #include\t<my/x.h>\n#include\n<no.h>"),
                 ("./b.cpp", "#include<vector>\n#include <boost/any.hpp>\n#include <QtCore/QList>"),
                 ("./c.js", "#include <map>"))
    found = f.includes(f.file_facts(files))
    assert rows_of(found.select("language", "header")) == [
        ("C", "my/x.h"), ("C", "stdio.h"), ("C++", "QtCore/QList"), ("C++", "boost/any.hpp"),
        ("C++", "vector")]
    libraries = f.header_libraries(found, f.standard_headers(spark))
    assert rows_of(libraries.select("language", "library")) == [
        ("C", "libc"), ("C++", "Boost"), ("C++", "Qt"), ("C++", "STL")]


def test_tools(tree):
    files = tree(("./.travis.yml", "language: js"), ("./Dockerfile", "short"),
                 ("./README.md", "x" * 30000 + "https://codecov.io/x http://codecov.io/y"),
                 ("./b.md", None), ("./c.txt", "https://snyk.io/"))
    assert rows_of(f.automation_tools(f.file_facts(files)).select("tool")) == [("codecov",), ("travis",)]
    assert f.tools_by_badge(f.file_facts(files, max_badge_chars=20480)).count() == 0


@pytest.mark.parametrize("path, expected", [
    ("./tests/a.js", True), ("./x/Test/a.js", True), ("./testing/a.js", False), ("./test.js", False)])
def test_tests_dir(tree, path, expected):
    assert f.tests_dir(tree((path, ""), ("./a", ""))).first().tests_dir_exists is expected


@pytest.mark.parametrize("path, kept", [
    ("./a.c", True), ("./a b.c", False), ("./x.DLL", False), ("./x.so.c", True), ("./ü.c", False),
    ("./node_modules/x.js", True)])
def test_path_veto(tree, path, kept):
    assert (f.veto_invalid(tree((path, ""), ("./ok.c", ""))).count() == 2) is kept


@pytest.mark.parametrize("path, kept", [
    ("./a.js", True), ("./x.so", False), ("./a/node_modules/x.js", False), ("./x.obj", True)])
def test_binary_veto(tree, path, kept):
    assert (f.veto_binaries(tree((path, ""))).count() == 1) is kept


def test_size_cap(tree, table):
    files = tree(("./a", "12345"), ("./b", "12345")).unionByName(tree(("./a", "1"), repo="r2"))
    assert rows_of(sf.cap_repo_size(files, 9).select("repo_id")) == [("r2",)]


def manifest(url=None, scripts=None, dev=(), **dependencies):
    return json.dumps({"repository": {"url": url} if url else "text", "scripts": scripts,
                       "dependencies": dependencies, "devDependencies": {k: "1" for k in dev}})


def test_manifests(tree):
    files = tree(
        ("./package.json", manifest("https://host/me/proj.git", {"start": "node x.js"},
                                    ["eslint", "@types/x"], react="1")),
        ("./bower.json", "{}"), ("./lib/package.json", manifest(lodash="1")), ("./lib/x.js", "1"),
        ("./lib2/y.js", "1"))
    rows = m.manifests(f.file_facts(files))
    top = m.top_manifests(rows)
    assert rows_of(m.manifest_dependencies(top).select("dependency")) == [("eslint",), ("react",)]
    assert rows_of(m.vendored_dirs(rows).select("dir")) == [("./lib",)]
    assert rows_of(m.drop_vendored(files, m.vendored_dirs(rows)).select("path")) == [
        ("./bower.json",), ("./lib2/y.js",), ("./package.json",)]
    assert m.uses_node(top, f.node_repositories(f.file_facts(files))).count() == 1
    assert m.manifest_origin_ok(rows).count() == 1


def test_vendored_folders_by_all_parents(table):
    """Nested and neighbouring folders, against a look at every parent folder of every file."""
    rng = random.Random(2)
    parts = ["a", "b", "a-b", "a.b", "a0", "é"]

    def path():
        return "./" + "/".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))

    dirs = {(rng.choice("rst"), path()) for _ in range(25)}
    files = [(rng.choice("rstu"), path() + "/f.js") for _ in range(200)] + [("r", None)]
    got = m.drop_vendored(table("repo_id string, path string", *files), table("repo_id string, dir string", *dirs))
    want = [(r, p) for r, p in files if p is None or not any((r, p[:i]) in dirs for i, c in enumerate(p) if c == "/")]
    assert rows_of(got) == sorted(want, key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 0


@pytest.mark.parametrize("url, ok", [
    (None, True), ("git@host:me/proj.git", True), ("https://host/you/proj", False),
    ("https://host/notme/proj", False)])
def test_origin(tree, url, ok):
    rows = m.manifests(f.file_facts(tree(("./package.json", manifest(url)))))
    assert (m.manifest_origin_ok(rows).count() == 1) is ok


def test_lint(table):
    rows = lint.lint_rows(table("repo_id string, value string", ("r", "WARN;a.c;x"), ("r", "WARN;a.h;y"),
                                ("r", "WARN;;y"), ("r", "WARN;a.c;"), ("r", "WARN"), ("r", "Checking a")))
    assert rows_of(rows) == [("r", "a.c", "x", "C"), ("r", "a.h", "y", "C++")]
    report = json.dumps([{"filePath": "a", "messages": [{"ruleId": "eqeqeq"}, {"ruleId": None}]},
                         {"filePath": "b", "messages": []}])
    found = lint.lint_json(table("repo_id string, value string", ("r", report), ("r", "no json")))
    assert rows_of(found) == [("r", "eqeqeq"), ("r", "null")]


def test_all_messages(tree, table):
    files = tree(("./package.json", manifest(react="1")), ("./a.js", "x\ny"), ("./a.min.js", "z"),
                 ("./test/t.js", "#!/usr/bin/env node")).unionByName(
        tree(("./a.c", "#include <stdio.h>\nint x;"), repo="r2")).unionByName(
        tree(("./bad name.c", "int x;"), repo="r3"))
    repositories = table("repo_id string, languages array<string>", ("r1", ["JavaScript"]),
                         ("r2", ["C", "C++"]), ("r3", ["C"]))
    findings = table("repo_id string, language string, rule string", ("r1", "JavaScript", "eqeqeq"),
                     ("r2", "C", "leak"), ("r3", "C", "leak"))
    got = analyze_files(files, repositories, findings)
    assert rows_of(got.drop("name")) == sorted([
        ("r1", "JavaScript", "dependence", "Node.js"), ("r1", "JavaScript", "dependence", "react"),
        ("r1", "JavaScript", "lines_of_code", "3"), ("r1", "JavaScript", "warning", "eqeqeq"),
        ("r1", "all_languages", "tests_dir_exists", "True"),
        ("r2", "C", "dependence", "libc"), ("r2", "C", "lines_of_code", "2"),
        ("r2", "C", "warning", "leak"), ("r2", "C++", "lines_of_code", "0"),
        ("r2", "all_languages", "tests_dir_exists", "False")], key=str)
    assert analyze_files(files, repositories, findings, max_bytes=1).count() == 0


def test_read_repo_files(spark, tmp_path):
    folder = tmp_path / "trees" / "r1" / "me" / "proj" / "src"
    folder.mkdir(parents=True)
    (folder / "a.c").write_text("int x;\n")
    (folder / "b.bin").write_bytes(b"\xff\xfe")
    files = sf.read_repo_files(spark, str(tmp_path / "trees"))
    assert rows_of(files) == [("r1", "proj", "me", "./src/a.c", 7, "int x;\n"),
                              ("r1", "proj", "me", "./src/b.bin", 2, None)]
    inner = folder / "trees" / "x"
    inner.mkdir(parents=True)
    (inner / "c.c").write_text("c")
    assert ("r1", "proj", "me", "./src/trees/x/c.c", 1, "c") in rows_of(
        sf.read_repo_files(spark, str(tmp_path / "trees")))


def test_dispatch(table):
    repos = table("repo_id string, languages array<string>", ("a", ["C", "C++", "HTML"]), ("b", ["Ada"]),
                  ("c", ["JavaScript", "C"]))
    assert rows_of(f.dispatch(repos)) == [("a", "cpp"), ("c", "cpp"), ("c", "javascript")]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_manifests_are_parsed_once(tree):
    files = tree(
        ("./package.json", '{"dependencies": {"a": "1", "@b/c": "1"}, "devDependencies": {"d": "1"}, '
                           '"scripts": {"start": "node x.js"}}'),
        ("./x/bower.json", '{"dependencies": [1], "devDependencies": {"e": {"f": 1}}, "scripts": "node y"}'),
        ("./y/bower.json", '{"dependencies": {"g": "1"}, "scripts": {"start": 7, "s": "node"}}'),
        ("./z/package.json", None), ("./i/package.json", "{broken"), ("./index.js", '{"dependencies": {"h": "1"}}'))
    rows = m.manifests(f.file_facts(files))
    names = m.manifest_dependencies(rows)
    assert rows_of(names.select("dependency")) == [("a",), ("d",), ("e",), ("g",)]
    assert rows_of(rows.select("path", "runs_node")) == [
        ("./i/package.json", False), ("./package.json", True), ("./x/bower.json", False), ("./y/bower.json", False),
        ("./z/package.json", False)]
    assert plan(names).count("from_json(") == 1


def test_reports_are_parsed_once(table):
    reports = table("id int, value string", (
        1, '[{"filePath": "a", "messages": [{"ruleId": "r"}, {"ruleId": null}]}, {"filePath": "b", "messages": []}]'),
        (2, "[]"), (3, None), (4, "[null]"), (5, "broken"))
    found = lint.lint_json(reports, path="path")
    assert rows_of(found) == [(1, "a", "null"), (1, "a", "r")]
    assert plan(found).count("from_json(") == 1


@pytest.mark.parametrize("name", ["findings_by_file"])
def test_package_files_are_made_once(spark, table, tmp_path, name):
    schema = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
              "l_extendedprice double, l_tax double, l_returnflag string, l_linestatus string")
    table(schema, (1, 1, 1, 1, 5.0, 9.0, 0.06, "A", "F"), (1, 2, 1, 2, 45.0, 9.0, 0.06, "R", "F")).write.parquet(
        f"{tmp_path}/lineitem.parquet")
    found = entry.queries()[name](spark, str(tmp_path))
    assert found.count() > 2 and "row_number" not in plan(found)
