"""Figures per developer and the ranking made from them.

Tables as in ``schemas.TABLES``; all sums are partial sums, so a developer with very many
repositories or grades is not gathered in one task.
"""

from pyspark.sql import Column, DataFrame, functions as F

from .ranked import global_row_number, top_n_per_group


def verified_technologies(technologies_users: DataFrame, settings: DataFrame,
                          developers: DataFrame) -> DataFrame:
    """(user_id, language, technology) that were verified, of users that are developers."""
    keys = ["user_id", "technology", "language"]  # numbers first, which sorts compare fastest
    verified = settings.filter("verified").select(*keys)
    return (
        technologies_users.select(*keys).join(verified, keys, "left_semi")
        .join(developers.select("user_id"), "user_id", "left_semi")
        .select("user_id", "language", "technology")
    )


def category_sums(repositories: DataFrame, grades: DataFrame) -> DataFrame:
    """(user_id, category, total, n): the one pass over the grades that the averages share."""
    owners = repositories.select("raw_id", "user_id")
    return grades.join(owners, "raw_id").groupBy("user_id", "category").agg(
        F.sum("value").alias("total"), F.count("value").alias("n")
    )


def category_means(sums: DataFrame) -> DataFrame:
    """Mean grade per user and category."""
    return sums.select("user_id", "category", (F.col("total") / F.col("n")).alias("value"))


def avg_of_category_means(means: DataFrame) -> DataFrame:
    """Mean of the category means, the figure shown with search results."""
    return means.groupBy("user_id").agg(F.avg("value").alias("avg_grade"))


def user_stats(repositories: DataFrame, sums: DataFrame) -> DataFrame:
    """(user_id, avg_grade, updated_by_analyzer, total_lines_of_code), complete rows only.

    ``avg_grade`` is the mean of all grades, not of the category means.
    """
    mean = sums.groupBy("user_id").agg(
        F.try_divide(F.sum("total"), F.sum("n")).alias("avg_grade")
    )
    repos = repositories.groupBy("user_id").agg(
        F.max("updated_by_analyzer").alias("updated_by_analyzer"),
        F.sum("lines_of_code").alias("total_lines_of_code"),
    )
    return mean.join(repos, "user_id").dropna()


def ranked(stats: DataFrame, order: str = "grade") -> DataFrame:
    """Number developers from 1; the larger the rank, the better.

    ``grade`` orders by (grade, update, lines of code), ``user_id`` by the id alone.
    """
    columns: list[Column] = [F.col("user_id")]
    if order == "grade":
        columns = [F.col("avg_grade"), F.col("updated_by_analyzer"),
                   F.col("total_lines_of_code"), *columns]
    return global_row_number(stats, columns)


def grade_documents(means: DataFrame) -> DataFrame:
    """(user_id, grades): JSON texts, one per category, sorted."""
    text = F.to_json(F.struct("category", "value"))
    return means.groupBy("user_id").agg(F.array_sort(F.collect_list(text)).alias("grades"))


def name_lists(technologies: DataFrame) -> DataFrame:
    """Display form: sorted distinct languages and technologies per user."""
    return technologies.groupBy("user_id").agg(
        F.array_sort(F.collect_set("language")).alias("languages"),
        F.array_sort(F.collect_set("technology")).alias("technologies"),
    )


def name_texts(technologies: DataFrame) -> DataFrame:
    """Languages and technologies per user as text, with repeats, sorted."""
    return technologies.groupBy("user_id").agg(
        F.array_join(F.array_sort(F.collect_list("language")), " ").alias("languages_text"),
        F.array_join(F.array_sort(F.collect_list("technology")), " ").alias("technologies_text"),
    )


def top_n_per_user(names: DataFrame, n: int = 5, column: str = "technology") -> DataFrame:
    """First ``n`` distinct names per user in alphabetical order."""
    return top_n_per_group(names.select("user_id", column).distinct(), ["user_id"],
                           [F.col(column)], n)
