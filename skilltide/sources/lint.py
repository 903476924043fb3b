"""Linter reports: delimited lines and nested JSON."""

from pyspark.sql import DataFrame, functions as F

from .languages import language_of_source

LINT_JSON = "ARRAY<STRUCT<filePath: STRING, messages: ARRAY<STRUCT<ruleId: STRING>>>>"


def lint_rows(reports: DataFrame, col: str = "value", prefix: str = "WARN") -> DataFrame:
    """``WARN;file;rule`` lines -> (..., language, file, rule); blanks and other lines dropped."""
    parts = F.split(F.col(col), ";")
    keep = [c for c in reports.columns if c != col]
    return (
        reports.filter(F.startswith(F.col(col), F.lit(prefix)))
        .select(*keep, F.get(parts, F.lit(1)).alias("file"), F.get(parts, F.lit(2)).alias("rule"))
        .filter((F.length("file") > 0) & (F.length("rule") > 0))
        .withColumn("language", language_of_source(F.col("file")))
    )


def lint_json(reports: DataFrame, col: str = "value", path: str | None = None) -> DataFrame:
    """JSON report -> one row per finding; a finding without a rule has the text ``null``.

    ``path`` names a column for the file of the finding.
    """
    keep = [c for c in reports.columns if c != col]
    # the outer form: for the inner one Spark tests the list first, and parses each report again for it
    files = reports.select(*keep, F.explode_outer(F.from_json(F.col(col), LINT_JSON)).alias("_file"))
    place = [F.col("_file.filePath").alias(path)] if path else []
    found = files.select(*keep, *place, F.explode("_file.messages").alias("_m"))
    return found.select(*keep, *([path] if path else []), F.coalesce(F.col("_m.ruleId"), F.lit("null")).alias("rule"))
