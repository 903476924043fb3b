"""From analyzer messages to grades."""

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.fixed import GRADE_CATEGORIES
from ..operators import grade as g


def grade(messages: DataFrame, catalog: DataFrame,
          categories: Sequence[str] = GRADE_CATEGORIES,
          skip_empty_languages: bool = False) -> DataFrame:
    """(repo_id, name, grade_category, value, lines_of_code), one row per repository and category.

    Repositories without dependencies are included; ``graded_with_technologies`` leaves them out.
    """
    missing = {"Automated", "Testable"} - set(categories)
    if missing:
        raise ValueError(f"categories must include {sorted(missing)}")
    values = g.language_values(messages, catalog, categories, skip_empty_languages)
    penalties = g.automation_penalty(messages).unionByName(g.testable_penalty(messages))
    return g.final_grades(values, penalties)


def graded_with_technologies(grades: DataFrame, messages: DataFrame) -> DataFrame:
    """Display form: one row per repository and language with dependencies, with the list of grades and the technologies of that language. Repositories without
    dependencies drop out."""
    maps = g.technology_maps(g.dependencies_of(messages))
    return g.grade_lists(grades).join(maps, ["repo_id", "name"])
