"""Identifiers and addresses."""

from pyspark.sql import Column, functions as F

from .fixed import OWNER_ID_PATTERN


def decode_owner_id(encoded: Column) -> Column:
    """Base64 ``NN:Type123`` -> struct(user_type, id); anything else -> ("Unknown", -1)."""
    text = F.try_to_binary(encoded, F.lit("base64")).cast("string")
    number = F.regexp_extract(text, OWNER_ID_PATTERN, 3).try_cast("long")
    user_type = F.regexp_extract(text, OWNER_ID_PATTERN, 2)
    return F.struct(
        F.when(number.isNotNull(), user_type).otherwise(F.lit("Unknown")).alias("user_type"),
        F.coalesce(number, F.lit(-1).cast("long")).alias("id"),
    )


def archive_url(login: Column, name: Column, branch: Column, host: str = "https://github.com") -> Column:
    """Address of the source archive of a branch."""
    return F.concat(F.lit(host + "/"), login, F.lit("/"), name, F.lit("/archive/"), branch,
                    F.lit(".tar.gz"))


def search_text(language: Column, filename: Column, min_size: Column, max_size: Column,
                min_stars: Column, max_stars: Column, pattern: Column) -> Column:
    """Text of one repository search; recently updated originals only."""
    return F.format_string(
        "language:%s in:%s sort:updated mirror:false fork:false size:%s..%s stars:%s..%s %s",
        language, filename, min_size.cast("string"), max_size.cast("string"),
        min_stars.cast("string"), max_stars.cast("string"), pattern,
    )
