"""Keyed merges: pure functions of the stored rows and a batch.

Each is idempotent: merging the same batch again changes nothing. When the batch is small Spark
broadcasts it (by its size at run time) and the stored rows are read but never shuffled.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def first_per_key(batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order. Aggregated map-side, so a hot key is cheap."""
    rest = [c for c in batch.columns if c not in keys]
    if not rest:
        return batch.distinct()
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return batch.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*batch.columns)


def _unknown_rows(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Batch rows whose key is not stored. The stored keys are first cut down to those of the
    batch, so that a small batch never makes the stored table move."""
    known = target.select(*keys).join(batch.select(*keys), list(keys), "left_semi")
    return batch.join(known, list(keys), "left_anti")


def insert_ignore(target: DataFrame, batch: DataFrame, keys: Sequence[str],
                  order: Sequence[Column] = ()) -> DataFrame:
    """Add rows with new keys; stored rows win. Within the batch the first in ``order`` wins."""
    rest = [F.col(c) for c in batch.columns if c not in keys]
    unique = first_per_key(batch, keys, order or rest)
    return target.unionByName(_unknown_rows(target, unique, keys), allowMissingColumns=True)


def insert_first(target: DataFrame, batch: DataFrame, keys: Sequence[str],
                 order: Sequence[Column]) -> DataFrame:
    """Insert-ignore where the first owner of a key keeps it."""
    return insert_ignore(target, batch, keys, order)


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], update: Sequence[str],
           order: Sequence[Column] = ()) -> DataFrame:
    """Add rows with new keys and replace only the ``update`` columns of stored ones."""
    rest = [F.col(c) for c in batch.columns if c not in keys]
    unique = first_per_key(batch, keys, order or rest)
    changes = unique.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in update],
                            F.lit(True).alias("_changed"))
    changed = target.join(changes, list(keys), "left")
    updated = changed.select(*[
        F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        if c in update else F.col(c)
        for c in target.columns
    ])
    return updated.unionByName(_unknown_rows(target, unique, keys), allowMissingColumns=True)


def upsert_flag_or(target: DataFrame, batch: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """A flag that only ever goes from false to true."""
    both = target.select(*keys, flag).unionByName(batch.select(*keys, flag))
    return both.groupBy(*keys).agg(F.bool_or(flag).alias(flag))


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition does not hold (or is unknown)."""
    return target.filter(~F.coalesce(condition, F.lit(False)))


def set_state(state: DataFrame, key: str, value: str) -> DataFrame:
    """Replace the value stored under a key; unknown keys change nothing."""
    return state.withColumn(
        "value", F.when(F.col("key") == key, F.lit(value)).otherwise(F.col("value"))
    )


def resolve_fk(df: DataFrame, dimension: DataFrame, column: str, key: str | None = None) -> DataFrame:
    """Keep a reference only if the dimension knows it, otherwise null."""
    known = dimension.select(F.col(key or column).alias(column), F.lit(True).alias("_known"))
    return (
        df.join(known.distinct(), column, "left")
        .withColumn(column, F.when(F.col("_known"), F.col(column)))
        .select(*df.columns)
    )
