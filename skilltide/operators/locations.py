"""Places named in free text, by a gazetteer the caller supplies."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

GAZETTEER = "alias STRING, kind STRING, city STRING, country STRING, population BIGINT"


def resolve_location(texts: DataFrame, keys: Sequence[str], text_col: str, gazetteer: DataFrame,
                     max_words: int = 3) -> DataFrame:
    """(keys, country, city), at most one place per text; nulls where none is recognised.

    Runs of one to ``max_words`` words are looked up in the gazetteer (alias, kind, city, country,
    population). A city wins over a state, a state over a country, then the larger population,
    then the alphabet. A city gives country and city, the others only the country.
    """
    words = F.filter(F.split(F.lower(F.col(text_col)), r"[\s,;/]+"), lambda w: w != "")
    tokenised = texts.select(*keys, words.alias("_words"))
    runs = F.flatten(F.transform(
        F.sequence(F.lit(1), F.lit(max_words)),
        lambda n: F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_words") - n + 1)),
            lambda i: F.array_join(F.slice("_words", i, n), " "),
        ),
    ))
    aliases = tokenised.select(*keys, F.explode(F.array_distinct(runs)).alias("_alias"))
    weight = (
        F.when(F.col("kind") == "city", 3).when(F.col("kind") == "state", 2).otherwise(1)
    )
    places = gazetteer.select(
        F.lower("alias").alias("_alias"), weight.alias("_weight"),
        F.coalesce("population", F.lit(0)).alias("_population"),
        "country", F.when(F.col("kind") == "city", F.col("city")).alias("city"),
    )
    best = aliases.join(places, "_alias").groupBy(*keys).agg(
        F.min_by(
            F.struct("country", "city"),
            F.struct(-F.col("_weight"), -F.col("_population"), F.col("_alias"), F.col("country")),
        ).alias("_place")
    )
    return texts.select(*keys).join(best, list(keys), "left").select(
        *keys, F.col("_place.country").alias("country"), F.col("_place.city").alias("city")
    )
