"""Row numbers and top-n that never send a whole group or table through one task."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import settle


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "rank",
                      partitions: int | None = None) -> DataFrame:
    """Number all rows 1..n in the given total order.

    Range-partitioned sort, then position in the partition plus the sizes of the partitions
    before it. Only the partition sizes meet in one task: one row per partition.
    ``order`` must be unique per row, so that ranges can cut anywhere.
    """
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settle(
        df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ranked",
    )
    part = F.shiftright("_at", 33)
    position = F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return (
        placed.withColumn("_part", part).join(offsets, "_part")
        .withColumn(name, position + F.col("_before") + 1)
        .drop("_at", "_part", "_before")
    )


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | Column,
                    name: str = "position", salts: int = 64) -> DataFrame:
    """First ``n`` rows of each group with their position from 1.

    A literal ``n`` within Spark's own limit is cut in each map task by the optimizer. Otherwise a
    first cut by (group, salt) spreads a hot group over ``salts`` tasks; a row beyond the first n
    of its part cannot be among the first n of the whole, so the result is exact.
    """
    native = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if isinstance(n, int) and n <= native:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    second = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_p", F.row_number().over(first)).filter(F.col("_p") <= n)
        .drop("_salt", "_p")
        .withColumn(name, F.row_number().over(second)).filter(F.col(name) <= n)
    )


def resume_from(df: DataFrame, order: Sequence[Column], saved_index: int,
                name: str = "index") -> DataFrame:
    """Rest of a cyclic work list after the saved position: all of it once the end was reached.

    Rows get their index from 0. An empty list stays empty.
    """
    numbered = global_row_number(df, order, "_n").withColumn(name, F.col("_n") - 1).drop("_n")
    total = numbered.agg(F.count("*").alias("total")).scalar()
    return numbered.filter(F.col(name) >= F.try_mod(F.lit(saved_index + 1), total))
