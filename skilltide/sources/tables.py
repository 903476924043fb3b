"""Named tables and pushed-down queries, from Parquet folders or over JDBC."""

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, name: str, root: str | None = None, **jdbc: str) -> DataFrame:
    """One table by name: a Parquet folder below ``root``, else a JDBC table, else the catalog.

    JDBC reads take ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``
    through ``jdbc`` so that a large table is not pulled by a single task.
    """
    if root is not None:
        return spark.read.parquet(f"{root}/{name}")
    if jdbc:
        return spark.read.format("jdbc").options(dbtable=name, **jdbc).load()
    return spark.table(name)


def read_query(spark: SparkSession, sql: str, views: dict[str, DataFrame] | None = None,
               **jdbc: str) -> DataFrame:
    """Rows of a query, run by the remote database (JDBC) or by Spark over the given views."""
    if jdbc:
        return spark.read.format("jdbc").options(query=sql, **jdbc).load()
    return spark.sql(sql, **(views or {}))


def warning_catalog(warnings: DataFrame, categories: DataFrame, languages: DataFrame) -> DataFrame:
    """(warning, language, grade_category) from the star of three keyed tables."""
    return (
        warnings
        .join(categories.select(F.col("id").alias("grade_category_id"),
                                F.col("category").alias("grade_category")), "grade_category_id")
        .join(languages.select(F.col("id").alias("language_id"), "language"), "language_id")
        .select("warning", "language", "grade_category")
    )


def grade_categories(categories: DataFrame) -> DataFrame:
    return categories.select(F.col("category").alias("grade_category"))


def search_list(queries: DataFrame, languages: DataFrame) -> DataFrame:
    """Enabled searches with their language name."""
    return (
        queries.filter("enabled")
        .join(languages.select(F.col("id").alias("language_id"), "language"), "language_id")
        .drop("language_id", "enabled")
    )
