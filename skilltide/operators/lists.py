"""Lists per group, for what is shown."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def sorted_lists(df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """(keys, list): one row per group with all its values, sorted; repeats stay.

    Every group becomes one value, whatever its size. Cut ``df`` down to the groups that are shown
    first, and stay with the long table for everything else.
    """
    return df.select(*keys, value.alias("_value")).groupBy(*keys).agg(
        F.array_sort(F.collect_list("_value")).alias(name))
