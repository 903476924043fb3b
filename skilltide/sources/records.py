"""Delimited analyzer records and the work list handed to analyzers."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

MESSAGE_FIELDS = ("repo_id", "name", "language", "message_type", "message")


def parse_records(lines: DataFrame, col: str = "value", sep: str = ";",
                  fields: Sequence[str] = MESSAGE_FIELDS) -> DataFrame:
    """Rows with exactly the given fields; trailing empty fields do not count, others do.

    A value that holds the separator therefore drops its row.
    """
    quoted = "\\" + sep
    parts = F.split(F.regexp_replace(F.col(col), f"({quoted})+$", ""), quoted)
    rows = lines.select(parts.alias("_parts")).filter(F.size("_parts") == len(fields))
    return rows.select(*[F.col("_parts")[i].alias(name) for i, name in enumerate(fields)])


def worklist_record(repo_id: Column, name: Column, login: Column, url: Column,
                    languages: Column, primary: Column) -> Column:
    """``id;name;login;url;lang1,lang2`` with the primary language among the languages."""
    return F.concat_ws(
        ";", repo_id, name, login, url,
        F.concat_ws(",", F.array_union(languages, F.array(primary))),
    )


def format_worklist(repositories: DataFrame) -> DataFrame:
    return repositories.select(
        worklist_record(
            F.col("repo_id"), F.col("name"), F.col("owner_login"), F.col("archive_url"),
            F.col("languages"), F.col("primary_language"),
        ).alias("value")
    )
