"""Numeric expressions used by the graders and filters."""

from pyspark.sql import Column, functions as F


def clamp01(value: Column) -> Column:
    """Limit a value to [0, 1]; nulls are skipped, as ``greatest``/``least`` do."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def category_value(warnings: Column, lines: Column) -> Column:
    """1 - warnings per line, at least 0. No lines of code gives 0.0."""
    return F.greatest(
        F.lit(0.0), F.lit(1.0) - F.try_divide(warnings.cast("double"), lines.cast("double"))
    )


def automation_penalty_value(tools: Column, full: int) -> Column:
    """0 with ``full`` or more tools, down to -1 with none."""
    full_tools = F.lit(float(full))
    return -F.greatest(F.lit(0.0), full_tools - tools.cast("double")) / full_tools


def array_sum(numbers: Column) -> Column:
    """Sum of an integer array; null elements count 0."""
    return F.aggregate(
        numbers, F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x.cast("long"), F.lit(0))
    )


def commit_ratio(owner: Column, everyone: Column) -> Column:
    """Owner commits / all commits for two arrays.

    A missing array gives 0.0. Without any commit the ratio is null rather than NaN: Spark sorts
    NaN above every number, so a NaN would pass a ``>=`` filter.
    """
    ratio = F.try_divide(array_sum(owner).cast("double"), array_sum(everyone).cast("double"))
    return F.when(owner.isNull() | everyone.isNull(), F.lit(0.0)).otherwise(ratio)
