"""Tables in folders by a hash of their key, so that a batch opens the folders of its own keys only."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Bucketed:
    """A stored table: its folder, the column that tells the bucket, and how many buckets there are."""

    spark: SparkSession
    path: str
    key: str
    buckets: int

    @property
    def rows(self) -> DataFrame:
        """The whole table."""
        return self.spark.read.parquet(self.path).drop("_bucket")

    def of(self, keys: DataFrame, column: str | None = None) -> DataFrame:
        """The rows with one of these keys.

        Which buckets they are in is asked first, and at most ``buckets`` numbers come to the driver; the
        scan then lists and reads those folders alone, whatever joins follow.
        """
        wanted = keys.select(F.col(column or self.key).alias(self.key))
        numbers = wanted.select(_bucket(self.key, self.buckets).alias("b")).distinct().collect()
        stored = self.spark.read.parquet(self.path)
        near = stored.where(F.col("_bucket").isin(sorted(r["b"] for r in numbers))).drop("_bucket")
        return near.join(wanted, self.key, "left_semi")


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int, mode: str = "errorifexists") -> Bucketed:
    """Store a table by buckets of its key. Rows are dealt out by bucket with a rebalance, which splits
    the bucket of a key that has very many rows over several files."""
    laid = df.withColumn("_bucket", _bucket(key, buckets)).hint("rebalance", "_bucket")
    laid.write.mode(mode).partitionBy("_bucket").parquet(path)
    return Bucketed(df.sparkSession, path, key, buckets)


def rows_of_keys(table: "DataFrame | Bucketed", keys: DataFrame, key: str,
                 column: str | None = None) -> DataFrame:
    """The rows of a plain or bucketed table that have one of the keys."""
    if isinstance(table, Bucketed):
        if table.key != key:
            raise ValueError(f"the table is in buckets of {table.key}, not of {key}")
        return table.of(keys, column)
    return table.join(keys.select(F.col(column or key).alias(key)), key, "left_semi")
