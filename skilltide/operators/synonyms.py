"""Technology names that are variants of a shorter name."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed import MIN_STEM_LENGTH, PACKAGE_MANAGER_LANGUAGES, SYNONYM_DELIMITERS
from .ranked import top_n_per_group


def technology_synonyms(technologies: DataFrame,
                        languages: Sequence[str] = PACKAGE_MANAGER_LANGUAGES,
                        min_length: int = MIN_STEM_LENGTH,
                        distinct_input: bool = True,
                        max_items: int | None = None) -> DataFrame:
    """(language, stem, synonym): one row per synonym, and one with a null synonym per stem.

    A name with one of ``-_.`` is a synonym if a shorter name of its language is contained in it;
    its stem is the shortest such name. All other names are stems, as are names shorter than
    ``min_length`` and names of languages without a package manager. Equal lengths are ordered by
    an optional ``position`` column, else alphabetically.

    All substrings of the names with a delimiter are matched by equality, so the cost grows with
    the names and not with their pairs, and no language is gathered in one task. With
    ``distinct_input=False`` a name that occurs twice and has a delimiter is a synonym of itself.
    ``max_items`` lets only the first so many names per language take part; the rest are stems.
    """
    order = F.col("position") if "position" in technologies.columns else F.col("technology")
    names = technologies.groupBy("language", "technology").agg(
        F.min(order).alias("_at"), F.count("*").alias("_n")
    )
    eligible = names.filter(
        F.col("language").isin(list(languages)) & (F.length("technology") >= min_length)
    )
    if max_items is not None:
        supported = names.filter(F.col("language").isin(list(languages)))
        first = top_n_per_group(supported, ["language"], [F.col("_at"), F.col("technology")],
                                max_items, "_pos")
        eligible = first.drop("_pos").filter(F.length("technology") >= min_length)

    delimited = eligible.filter(F.col("technology").rlike(f"[{SYNONYM_DELIMITERS}]"))
    size = F.length("technology")
    starts = F.sequence(F.lit(1), size - min_length + 1)
    substrings = F.flatten(F.transform(
        starts,
        lambda i: F.transform(
            F.sequence(F.lit(min_length), size - i + 1),
            lambda n: F.substring(F.col("technology"), i, n),
        ),
    ))
    parts = delimited.select(
        "language", F.col("technology").alias("synonym"), F.col("_at").alias("_synonym_at"),
        F.col("_n").alias("_synonym_n"), F.explode(F.array_distinct(substrings)).alias("stem"),
    )
    candidates = eligible.select("language", F.col("technology").alias("stem"),
                                 F.col("_at").alias("_stem_at"))
    matches = parts.join(candidates, ["language", "stem"]).filter(
        (F.col("stem") != F.col("synonym")) | ((F.col("_synonym_n") > 1) & F.lit(not distinct_input))
    )
    found = matches.groupBy("language", "synonym").agg(
        F.min_by("stem", F.struct(F.length("stem"), F.col("_stem_at"), F.col("stem"))).alias("stem")
    )
    absorbed = found.filter(F.col("stem") != F.col("synonym")).select(
        "language", F.col("synonym").alias("technology"))
    stems = names.join(absorbed, ["language", "technology"], "left_anti").select(
        "language", F.col("technology").alias("stem"), F.lit(None).cast("string").alias("synonym")
    )
    return stems.unionByName(found.select("language", "stem", "synonym"))


def synonym_flags(synonyms: DataFrame) -> DataFrame:
    """(language, technology, synonym): every name with its flag."""
    return synonyms.select(
        "language", F.coalesce("synonym", "stem").alias("technology"),
        F.col("synonym").isNotNull().alias("synonym"),
    ).groupBy("language", "technology").agg(F.bool_or("synonym").alias("synonym"))
