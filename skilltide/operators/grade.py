"""Grades from analyzer messages (repo_id, name, language, message_type, message)."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed import (
    AUTOMATION_TOOL, DEPENDENCE, FULL_AUTOMATION_TOOLS, GRADE_CATEGORIES, LINES_OF_CODE,
    TESTS_DIR_EXISTS, WARNING,
)
from ..functions.numbers import automation_penalty_value, category_value, clamp01
from .lists import sorted_lists

REPO = ("repo_id", "name")
REPO_LANGUAGE = ("repo_id", "name", "language")


def messages_of(messages: DataFrame, message_type: str) -> DataFrame:
    """Messages of one kind; the filter reaches the scan."""
    return messages.filter(F.col("message_type") == message_type).drop("message_type")


def lines_of_code_of(messages: DataFrame) -> DataFrame:
    """Lines per repository and language. One row per pair is expected; repeats count again."""
    return messages_of(messages, LINES_OF_CODE).select(
        *REPO_LANGUAGE, F.col("message").try_cast("long").alias("lines_of_code")
    )


def matched_warning_counts(messages: DataFrame, catalog: DataFrame) -> DataFrame:
    """Warnings per repository, language and category. A warning of two categories counts in both,
    one missing from the catalog in none.

    The catalog is small, so Spark joins it in the scan by its size, and the findings are counted
    map-side: one shuffle of at most one row per repository, language, category and task.
    """
    findings = messages_of(messages, WARNING).withColumnRenamed("message", "warning")
    return (
        findings.join(catalog, ["language", "warning"])
        .groupBy(*REPO_LANGUAGE, "grade_category").agg(F.count("*").alias("warnings"))
    )


def with_categories(df: DataFrame, categories: Sequence[str] = GRADE_CATEGORIES) -> DataFrame:
    """Repeat each row once per category. The list is a handful of names, no join is needed."""
    names = F.array(*[F.lit(c) for c in categories])
    return df.withColumn("grade_category", F.explode(names))


def warning_counts(messages: DataFrame, catalog: DataFrame,
                   categories: Sequence[str] = GRADE_CATEGORIES) -> DataFrame:
    """Warnings per repository, language and category, 0 where there are none, for every
    repository and language that has any message."""
    pairs = messages.select(*REPO_LANGUAGE).distinct()
    return _zero_filled(with_categories(pairs, categories), messages, catalog)


def _zero_filled(frame: DataFrame, messages: DataFrame, catalog: DataFrame) -> DataFrame:
    keys = [*REPO_LANGUAGE, "grade_category"]
    return frame.join(matched_warning_counts(messages, catalog), keys, "left").withColumn(
        "warnings", F.coalesce("warnings", F.lit(0).cast("long"))
    )


def language_values(messages: DataFrame, catalog: DataFrame,
                    categories: Sequence[str] = GRADE_CATEGORIES,
                    skip_empty_languages: bool = False) -> DataFrame:
    """Value per repository, language and category: 1 - warnings / lines of code, at least 0.

    Starts from the lines-of-code rows: pairs without one have no value, and the many warning rows
    are already counted when they meet them. A language with no lines is worth 0.0 unless skipped.
    """
    lines = lines_of_code_of(messages)
    if skip_empty_languages:
        lines = lines.filter(F.col("lines_of_code") > 0)
    return _zero_filled(with_categories(lines, categories), messages, catalog).withColumn(
        "value", category_value(F.col("warnings"), F.col("lines_of_code"))
    )


def category_values(language_value_rows: DataFrame) -> DataFrame:
    """Over languages: sum of the lines, plain mean of the values."""
    return language_value_rows.groupBy(*REPO, "grade_category").agg(
        F.sum("lines_of_code").alias("lines_of_code"), F.avg("value").alias("value")
    )


def automation_penalty(messages: DataFrame, max_tools: int = FULL_AUTOMATION_TOOLS) -> DataFrame:
    """Penalty per repository, also for those without any tool."""
    tools = F.count_if(F.col("message_type") == AUTOMATION_TOOL)
    return messages.groupBy(*REPO).agg(tools.alias("tools")).select(
        *REPO, F.lit("Automated").alias("grade_category"),
        automation_penalty_value(F.col("tools"), max_tools).alias("value"),
    )


def testable_penalty(messages: DataFrame) -> DataFrame:
    """0 when a tests directory exists, else -1."""
    return messages_of(messages, TESTS_DIR_EXISTS).select(
        *REPO, F.lit("Testable").alias("grade_category"),
        (F.col("message").try_cast("boolean").cast("double") - 1.0).alias("value"),
    )


def final_grades(values: DataFrame, penalties: DataFrame) -> DataFrame:
    """Mean over languages plus penalties, within [0, 1]; one shuffle for both inputs."""
    rows = values.select(
        *REPO, "grade_category", "lines_of_code", "value", F.lit(None).cast("double").alias("_p")
    ).unionByName(penalties.select(
        *REPO, "grade_category", F.lit(0).cast("long").alias("lines_of_code"),
        F.lit(None).cast("double").alias("value"), F.col("value").alias("_p"),
    ))
    mean, penalty = F.col("value"), F.col("_p")
    return rows.groupBy(*REPO, "grade_category").agg(
        F.avg("value").alias("value"), F.sum("_p").alias("_p"),
        F.sum("lines_of_code").alias("lines_of_code"),
    ).select(
        *REPO, "grade_category",
        clamp01(F.coalesce(mean + penalty, mean, penalty)).alias("value"), "lines_of_code",
    )


def dependencies_of(messages: DataFrame) -> DataFrame:
    """Distinct (repository, language, technology)."""
    return (
        messages_of(messages, DEPENDENCE)
        .select(*REPO_LANGUAGE, F.col("message").alias("technology")).distinct()
    )


def grade_lists(grades: DataFrame) -> DataFrame:
    """One row per repository with its grades, at most one per category."""
    return grades.groupBy(*REPO, "lines_of_code").agg(
        F.array_sort(F.collect_list(F.struct("grade_category", "value"))).alias("grades")
    )


def technology_maps(dependencies: DataFrame) -> DataFrame:
    """(repository, {language: [technologies]}), for display: one row per language. Large jobs should
    stay with the long table."""
    lists = sorted_lists(dependencies.distinct(), REPO_LANGUAGE, F.col("technology"), "technologies")
    return lists.select(
        *REPO, F.create_map("language", "technologies").alias("language_to_technologies"))


def merge_maps(maps: DataFrame, keys: Sequence[str], map_col: str) -> DataFrame:
    """Long form of merged maps of lists: (keys, key, value), repeats kept, empty lists as null."""
    return maps.select(*keys, F.explode(map_col).alias("key", "_values")).select(
        *keys, "key", F.explode_outer("_values").alias("value")
    )


def collect_map(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, key, values): display form of ``merge_maps``, one row per key of each map. Values are
    sorted; an empty list stays."""
    lists = sorted_lists(long, [*keys, "key"], F.col("value"), "values")
    return lists.withColumn("values", F.array_compact("values"))
