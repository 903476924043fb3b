"""Merging one batch of results into the stored tables."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import extract as ex, merge
from ..operators.synonyms import synonym_flags, technology_synonyms

Tables = dict[str, DataFrame]


class Batch(NamedTuple):
    """Results of one run, all in long form.

    users: user_id, login, full_name, description, location, company, email, blog, job_seeker
    repositories: user_id, raw_id, primary_language, languages
    grades: raw_id, name, grade_category, value, lines_of_code
    technologies: raw_id, language, technology
    locations: user_id, country, city
    """

    users: DataFrame
    repositories: DataFrame
    grades: DataFrame
    technologies: DataFrame
    locations: DataFrame


class Rule(NamedTuple):
    """How rows of a table meet stored rows with the same key: ``update`` columns are replaced,
    ``flag`` goes from false to true, everything else stays as first stored."""

    keys: tuple[str, ...]
    update: tuple[str, ...] = ()
    flag: str | None = None


RULES = {
    "languages": Rule(("language",)),
    "countries": Rule(("country",)),
    "cities": Rule(("city",)),
    "users": Rule(("user_id",), ("login", "full_name")),
    "developers": Rule(("user_id",)),
    "contacts": Rule(("category", "contact")),
    "technologies": Rule(("language", "technology"), flag="synonym"),
    "technologies_users": Rule(("language", "technology", "user_id")),
    "technologies_users_settings": Rule(("language", "technology", "user_id"), ("verified",)),
    "repositories": Rule(("raw_id",), ("lines_of_code", "updated_by_analyzer")),
    "grades": Rule(("category", "raw_id"), ("value",)),
}


def _owned(batch: Batch, rows: DataFrame) -> DataFrame:
    """Rows about repositories with the owner of the repository."""
    return rows.join(batch.repositories.select("raw_id", "user_id"), "raw_id")


def language_rows(batch: Batch, now: Column) -> DataFrame:
    return ex.languages_of(batch.repositories)


def country_rows(batch: Batch, now: Column) -> DataFrame:
    return batch.locations.select("country").filter("country IS NOT NULL").distinct()


def city_rows(batch: Batch, now: Column) -> DataFrame:
    return batch.locations.select("city").filter("city IS NOT NULL").distinct()


def user_rows(batch: Batch, now: Column) -> DataFrame:
    return batch.users.select(
        "user_id", "login", F.coalesce("full_name", F.lit("")).alias("full_name"),
        F.lit(None).cast("timestamp_ntz").alias("updated_by_user"),
    )


def developer_rows(batch: Batch, now: Column) -> DataFrame:
    none = F.lit(None)
    return batch.users.join(batch.locations, "user_id", "left").select(
        "user_id", none.cast("boolean").alias("show_email"),
        F.coalesce("job_seeker", F.lit(False)).alias("job_seeker"),
        none.cast("boolean").alias("available_for_relocation"),
        none.cast("smallint").alias("programming_experience_months"),
        none.cast("smallint").alias("work_experience_months"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("location", F.lit("")).alias("raw_location"),
        "country", "city", F.lit(0).alias("viewed"),
    )


def contact_rows(batch: Batch, now: Column) -> DataFrame:
    return ex.contacts_of(batch.users)


def technology_rows(batch: Batch, now: Column) -> DataFrame:
    return synonym_flags(technology_synonyms(batch.technologies.select("language", "technology")))


def user_technology_rows(batch: Batch, now: Column) -> DataFrame:
    return _owned(batch, batch.technologies).select("language", "technology", "user_id").distinct()


def setting_rows(batch: Batch, now: Column) -> DataFrame:
    return user_technology_rows(batch, now).withColumn("verified", F.lit(True))


def repository_rows(batch: Batch, now: Column) -> DataFrame:
    return _owned(batch, batch.grades).groupBy("raw_id").agg(
        F.min("user_id").alias("user_id"), F.min("name").alias("name"),
        F.max("lines_of_code").alias("lines_of_code"),
    ).withColumn("updated_by_analyzer", now.cast("timestamp_ntz"))


def grade_rows(batch: Batch, now: Column) -> DataFrame:
    graded = _owned(batch, batch.grades)
    return graded.select(F.col("grade_category").alias("category"), "raw_id", "value")


# Rows a batch brings to each table, in the order in which tables refer to each other.
ROWS = {
    "languages": language_rows,
    "technologies": technology_rows,
    "countries": country_rows,
    "cities": city_rows,
    "users": user_rows,
    "developers": developer_rows,
    "contacts": contact_rows,
    "technologies_users": user_technology_rows,
    "technologies_users_settings": setting_rows,
    "repositories": repository_rows,
    "grades": grade_rows,
}


def merge_table(name: str, target: DataFrame, rows: DataFrame) -> DataFrame:
    """Merge rows into one table by its rule; among equal keys of the batch the least row wins."""
    rule = RULES[name]
    if rule.flag:
        return merge.upsert_flag_or(target, rows, rule.keys, rule.flag)
    if rule.update:
        return merge.upsert(target, rows, rule.keys, rule.update)
    return merge.insert_ignore(target, rows, rule.keys)


def persist(batch: Batch, tables: Tables, now: Column) -> Tables:
    """The stored tables after the batch. Pure: nothing is written."""
    merged = {name: merge_table(name, tables[name], rows(batch, now)) for name, rows in ROWS.items()}
    return {**tables, **merged}
