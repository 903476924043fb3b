"""From repository files to analyzer messages."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import (
    ALL_LANGUAGES, AUTOMATION_TOOL, DEPENDENCE, LINES_OF_CODE, TESTS_DIR_EXISTS, WARNING,
)
from ..operators import files as f, manifests as m
from ..sources.bucketed import Bucketed, rows_of_keys
from ..storage import settle
from .candidates import Developers


def _message(rows: DataFrame, kind: str, language: Column, message: Column) -> DataFrame:
    return rows.select(
        "repo_id", F.col("repo_name").alias("name"), language.alias("language"),
        F.lit(kind).alias("message_type"), message.cast("string").alias("message"),
    )


def general_messages(facts: DataFrame) -> DataFrame:
    """Automation tools and the tests directory."""
    every = F.lit(ALL_LANGUAGES)
    exists = F.when(F.col("tests_dir_exists"), "True").otherwise("False")
    return _message(f.automation_tools(facts), AUTOMATION_TOOL, every, F.col("tool")).unionByName(
        _message(f.tests_dir(facts), TESTS_DIR_EXISTS, every, exists))


def cpp_messages(facts: DataFrame, findings: DataFrame) -> DataFrame:
    """Warnings, libraries and lines of C and C++; both languages always report their lines."""
    language = F.col("language")
    none = facts.select(*f.REPO).distinct().select(
        *f.REPO, F.explode(F.array(F.lit("C"), F.lit("C++"))).alias("language"),
        F.lit(0).cast("long").alias("lines_of_code"))
    counted = f.lines_of_code(facts.filter(language.isin("C", "C++")))
    lines = counted.unionByName(none).groupBy(*f.REPO, "language").agg(
        F.max("lines_of_code").alias("lines_of_code"))
    libraries = f.header_libraries(f.includes(facts), f.standard_headers(facts.sparkSession))
    repos = facts.select(*f.REPO).distinct()
    warnings = findings.filter(language.isin("C", "C++")).join(repos, "repo_id")
    return (
        _message(warnings, WARNING, language, F.col("rule"))
        .unionByName(_message(libraries, DEPENDENCE, language, F.col("library")))
        .unionByName(_message(lines, LINES_OF_CODE, language, F.col("lines_of_code")))
    )


def javascript_messages(facts: DataFrame, findings: DataFrame) -> DataFrame:
    """Dependencies, warnings and lines of repositories with a manifest of the right origin and
    nothing compiled; copied libraries are left out.

    ``facts`` with the columns has_binary and has_node_shebang of the repository.
    """
    language = F.lit("JavaScript")
    clean = facts.filter(~F.col("has_binary"))
    every = m.manifests(clean)
    known = settle(every.join(m.manifest_origin_ok(every), "repo_id", "left_semi"), "manifests")
    vendored = m.vendored_dirs(known)
    own = f.clean_sources(m.drop_vendored(clean.filter(F.col("language") == "JavaScript"), vendored))
    top = m.top_manifests(known)
    shebang = clean.filter("has_node_shebang").select("repo_id").distinct()
    node = m.uses_node(top, shebang).withColumn("dependency", F.lit("Node.js"))
    dependencies = m.manifest_dependencies(top).unionByName(node)
    repos = known.select(*f.REPO).distinct()
    lines = repos.join(f.lines_of_code(own).drop("language"), list(f.REPO), "left")
    found = findings.filter(F.col("language") == "JavaScript")
    if "path" in findings.columns:
        placed = found.filter("path IS NOT NULL")
        found = f.clean_sources(m.drop_vendored(placed, vendored)).unionByName(found.filter("path IS NULL"))
    warnings = found.join(repos, "repo_id")
    return (
        _message(dependencies, DEPENDENCE, language, F.col("dependency"))
        .unionByName(_message(warnings, WARNING, language, F.col("rule")))
        .unionByName(_message(lines, LINES_OF_CODE, language,
                              F.coalesce("lines_of_code", F.lit(0))))
    )


def analyze_files(files: DataFrame, repositories: DataFrame, findings: DataFrame,
                  max_bytes: int | None = None) -> DataFrame:
    """All messages about repositories (repo_id, languages) from their files and the findings of
    linters (repo_id, language, rule). Too large or suspicious repositories give none.

    Findings may have the ``path`` of their file, as in the table of files. Those in copied libraries,
    minified scripts and linter settings of JavaScript then do not count; a null path is everywhere.

    Contents are read once, into a table of facts in the shared folder; verdicts about whole
    repositories are made from the facts, so no content is ever shuffled.
    """
    facts = settle(f.file_facts(files), "file-facts")
    good = f.repository_verdicts(facts).filter(~F.col("has_bad_path"))
    if max_bytes is not None:
        good = good.filter(F.col("total_size") <= max_bytes)
    analyzers = f.dispatch(repositories).groupBy("repo_id").agg(
        F.bool_or(F.col("analyzer") == "cpp").alias("cpp"),
        F.bool_or(F.col("analyzer") == "javascript").alias("javascript"))
    valid = settle(facts.join(good.join(analyzers, "repo_id", "left"), "repo_id"), "valid-facts")
    return (
        general_messages(valid)
        .unionByName(cpp_messages(valid.filter("cpp"), findings))
        .unionByName(javascript_messages(valid.filter("javascript"), findings))
    )


def analyse_with(files: DataFrame | Bucketed, findings: DataFrame | Bucketed,
                 max_bytes: int | None = None) -> Callable[[Developers], DataFrame]:
    """Analysis of the repositories of a batch from tables of files and findings, plain or in buckets of
    repo_id. Both are cut down to the batch first."""
    def analyse(developers: Developers) -> DataFrame:
        none = F.array().cast("array<string>")
        repositories = developers.repositories.select("repo_id", F.array_union(
            F.coalesce("languages", none), F.array("primary_language")).alias("languages"))
        ids = repositories.select("repo_id")
        return analyze_files(
            rows_of_keys(files, ids, "repo_id"), repositories, rows_of_keys(findings, ids, "repo_id"),
            max_bytes)

    return analyse
