"""Findings from repository files.

``file_facts`` reads each content once and keeps what the other operators need; they work on those
facts, so contents are never shuffled. Paths are relative to the repository. Per-repository results
are partial aggregates, so a repository that holds a third of all files is spread like any other.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import (
    AUTOMATION_BADGES, AUTOMATION_FILES, BINARY_FILE_PATTERN, COMMENT_PATTERN, HEADER_LIBRARIES,
    HEADER_PREFIXES, INCLUDE_PATTERN, INVALID_EXTENSION_PATTERN, LANGUAGE_ANALYZERS, MIN_TOOL_FILE_BYTES,
    NODE_SHEBANG_PATTERN, NOISE_FILE_PATTERN, TESTS_DIR_PATTERN, VALID_PATH_PATTERN,
    VENDOR_DIR_PATTERN,
)
from ..sources.languages import extension, language_of
from .manifests import is_manifest, manifest_url, package

REPO = ("repo_id", "repo_name")


def without_comments(content: Column) -> Column:
    """A source without ``//`` and ``/* */`` comments, line ends inside the latter included.

    Comment marks in string literals stay; an unclosed ``/*`` runs to the end. Regular expression
    literals and raw strings are not recognised, so a mark or an unpaired quote in one of them counts.
    """
    marked = F.contains(content, F.lit("//")) | F.contains(content, F.lit("/*"))
    return F.when(marked, F.regexp_replace(content, COMMENT_PATTERN, "$1")).otherwise(content)


def count_code_lines(content: Column) -> Column:
    """Lines with a visible character; matched in place, no list of lines is built."""
    return F.regexp_count(content, F.lit(r"\S[^\r\n]*")).cast("long")


def badge_tools(content: Column, badges: Mapping[str, str] = AUTOMATION_BADGES,
                max_chars: int | None = None) -> Column:
    """Tools whose address occurs in a text. The whole text is searched unless ``max_chars`` limits
    it to the beginning; missing text matches nothing."""
    text = content if max_chars is None else F.substring(content, 1, max_chars)
    hits = [F.when(F.contains(text, F.lit(address)), F.lit(tool)) for address, tool in badges.items()]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def included_headers(content: Column, pattern: str = INCLUDE_PATTERN) -> Column:
    """Distinct headers of a source, the first include of each line."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)))


def file_facts(files: DataFrame, badges: Mapping[str, str] = AUTOMATION_BADGES,
               max_badge_chars: int | None = None) -> DataFrame:
    """What is needed of each file (repo_id, repo_name, login, path, size, content), without its
    content. A narrow projection: unused columns are never computed."""
    path, content = F.col("path"), F.col("content")
    language, manifest, code = F.col("language"), F.col("is_manifest"), without_comments(content)
    known = files.select(
        *REPO, "login", "path", "size", "content", language_of(path).alias("language"),
        is_manifest(path).alias("is_manifest"))
    return known.withColumn("_package", F.when(manifest, package(content))).select(
        *REPO, "login", "path", "size", "language",
        F.when(language.isNotNull(), F.coalesce(count_code_lines(code), F.lit(0)))
        .alias("code_lines"),
        F.when(language.isin("C", "C++"), included_headers(code)).alias("headers"),
        F.when(extension(path) == ".md", badge_tools(content, badges, max_badge_chars))
        .alias("badge_tools"),
        content.rlike(NODE_SHEBANG_PATTERN).alias("node_shebang"),
        "is_manifest",
        F.when(manifest, manifest_url(content)).alias("manifest_url"),
        "_package.dependencies", "_package.runs_node",
    )


def is_bad_path() -> Column:
    """The path has unusual characters or belongs to a compiled file."""
    path = F.replace(F.col("path"), F.col("repo_id"), F.lit(""))
    return ~path.rlike(VALID_PATH_PATTERN) | extension(path).rlike(INVALID_EXTENSION_PATTERN)


def is_binary_path() -> Column:
    """The path belongs to a compiled file or a folder of installed packages."""
    return F.col("path").rlike(BINARY_FILE_PATTERN) | F.col("path").rlike(VENDOR_DIR_PATTERN)


def repository_verdicts(facts: DataFrame) -> DataFrame:
    """(repo_id, total_size, has_bad_path, has_binary, has_node_shebang) in one aggregation."""
    return facts.groupBy("repo_id").agg(
        F.sum("size").alias("total_size"), F.bool_or(is_bad_path()).alias("has_bad_path"),
        F.bool_or(is_binary_path()).alias("has_binary"),
        F.bool_or(F.coalesce("node_shebang", F.lit(False))).alias("has_node_shebang"),
    )


def invalid_repositories(files: DataFrame) -> DataFrame:
    """Ids of repositories with a path of unusual characters or a compiled file."""
    return files.filter(is_bad_path()).select("repo_id").distinct()


def veto_invalid(files: DataFrame) -> DataFrame:
    """One bad path drops the whole repository."""
    return files.join(invalid_repositories(files), "repo_id", "left_anti")


def binary_repositories(files: DataFrame) -> DataFrame:
    """Ids of repositories with a compiled file or a folder of installed packages."""
    return files.filter(is_binary_path()).select("repo_id").distinct()


def veto_binaries(files: DataFrame) -> DataFrame:
    return files.join(binary_repositories(files), "repo_id", "left_anti")


def clean_sources(files: DataFrame) -> DataFrame:
    """Drop linter settings, lock files, minified scripts and ignore lists."""
    return files.filter(~F.col("path").rlike(NOISE_FILE_PATTERN))


def tools_by_filename(files: DataFrame, names: Mapping[str, str] = AUTOMATION_FILES,
                      min_bytes: int = MIN_TOOL_FILE_BYTES) -> DataFrame:
    """Distinct (repository, tool) by the name of a non-trivial file."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    tool = F.try_element_at(table, F.substring_index(F.col("path"), "/", -1))
    return (
        files.filter(F.col("size") > min_bytes).select(*REPO, tool.alias("tool"))
        .filter(F.col("tool").isNotNull()).distinct()
    )


def tools_by_badge(facts: DataFrame) -> DataFrame:
    """Distinct (repository, tool) by an address in a Markdown file."""
    return facts.select(*REPO, F.explode("badge_tools").alias("tool")).distinct()


def automation_tools(facts: DataFrame, names: Mapping[str, str] = AUTOMATION_FILES) -> DataFrame:
    """Distinct (repository, tool) by file name or badge."""
    return tools_by_filename(facts, names).unionByName(tools_by_badge(facts)).distinct()


def tests_dir(files: DataFrame) -> DataFrame:
    """(repository, tests_dir_exists) for every repository."""
    return files.groupBy(*REPO).agg(
        F.bool_or(F.col("path").rlike(TESTS_DIR_PATTERN)).alias("tests_dir_exists")
    )


def lines_of_code(facts: DataFrame) -> DataFrame:
    """(repository, language, lines_of_code) of files an analyzer reads."""
    return facts.filter(F.col("language").isNotNull()).groupBy(*REPO, "language").agg(
        F.sum("code_lines").alias("lines_of_code"))


def includes(facts: DataFrame) -> DataFrame:
    """Distinct (repository, language, header)."""
    return facts.select(*REPO, "language", F.explode("headers").alias("header")).distinct()


def standard_headers(spark) -> DataFrame:
    """(language, header, library) of the known libraries."""
    rows = [(lang, h, lib) for lang, lib, names in HEADER_LIBRARIES for h in names.split()]
    return spark.createDataFrame(rows, "language string, header string, library string")


def header_libraries(headers: DataFrame, exact: DataFrame,
                     prefixes: Sequence[tuple[str, str, str]] = HEADER_PREFIXES) -> DataFrame:
    """Distinct (repository, language, library), by whole header or by its beginning."""
    by_name = headers.join(exact, ["language", "header"]).select(*REPO, "language", "library")
    by_prefix = headers.select(*REPO, "language", F.explode(F.array_compact(F.array(*[
        F.when((F.col("language") == lang) & F.startswith(F.col("header"), F.lit(prefix)),
               F.lit(library))
        for lang, prefix, library in prefixes
    ]))).alias("library"))
    return by_name.unionByName(by_prefix).distinct()


def node_repositories(facts: DataFrame) -> DataFrame:
    """Ids of repositories with a script for Node.js."""
    return facts.filter("node_shebang").select("repo_id").distinct()


def dispatch(repositories: DataFrame,
             analyzers: Sequence[tuple[str, str]] = LANGUAGE_ANALYZERS) -> DataFrame:
    """Distinct (repo_id, analyzer) for the languages of a repository."""
    table = F.create_map(*[F.lit(x) for pair in analyzers for x in pair])
    names = F.transform("languages", lambda language: F.try_element_at(table, language))
    return repositories.select(
        "repo_id", F.explode(F.array_distinct(F.array_compact(names))).alias("analyzer")
    ).distinct()
