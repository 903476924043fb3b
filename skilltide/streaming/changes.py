"""Batch results kept as appended changes.

Each micro-batch writes its rows to its own folder ``<table>/batch=<id>``. A repeated batch
overwrites only that folder, so a retry leaves the same rows. Nothing stored is rewritten while the
stream runs; the merged table is one aggregation over the changes, and ``compact`` stores it.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.persisting import RULES, Rule
from ..schemas import SIDE_TABLES, TABLES
from .commits import Commits


def append_changes(rows: DataFrame, root: str, table: str, batch_id: int) -> None:
    """Store the rows of one batch; repeating it replaces them."""
    rows.write.mode("overwrite").parquet(f"{root}/{table}/batch={batch_id}")


def read_changes(spark: SparkSession, root: str, table: str, schema: str,
                 before: int | None = None) -> DataFrame:
    """All stored rows with their ``batch``, optionally only of earlier batches.

    Where the store has commit files (``commits``), rows of committed batches only.
    """
    log = Commits(spark, root)
    if log.exists():
        return log.read(table, schema, before=before)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = f"{schema}, batch BIGINT"
    if not files.exists(path):
        return spark.createDataFrame([], full)
    rows = spark.read.schema(full).parquet(f"{root}/{table}")
    return rows if before is None else rows.filter(F.col("batch") < before)


def merged(changes: DataFrame, rule: Rule) -> DataFrame:
    """Rows by the table's rule: columns as first stored, ``update`` columns as last stored, the
    flag true once it was. Partial aggregates, one shuffle."""
    rest = [c for c in changes.columns if c not in rule.keys and c != "batch"]
    first = [c for c in rest if c not in rule.update and c != rule.flag]
    row = F.struct(*rest) if rest else F.lit(0)
    aggregates = []
    if first:
        aggregates.append(F.min_by(F.struct(*first), F.struct("batch", row)).alias("_first"))
    if rule.update:
        # the batch's least row wins, as in a merge: latest batch, then smallest row
        aggregates.append(F.min_by(F.struct(*rule.update), F.struct(-F.col("batch"), row))
                          .alias("_last"))
    if rule.flag:
        aggregates.append(F.bool_or(rule.flag).alias(rule.flag))
    columns = [c for c in changes.columns if c != "batch"]
    if not aggregates:
        return changes.select(*rule.keys).distinct().select(*columns)
    grouped = changes.groupBy(*rule.keys).agg(*aggregates)
    fields = [*rule.keys, *(["_first.*"] if first else []), *(["_last.*"] if rule.update else []),
              *([rule.flag] if rule.flag else [])]
    return grouped.select(*fields).select(*columns)


def read_stored(spark: SparkSession, root: str, table: str, before: int | None = None) -> DataFrame:
    """One stored table as of the given batch."""
    return merged(read_changes(spark, root, table, TABLES[table], before), RULES[table])


def compact(spark: SparkSession, root: str, target: str, upto: int) -> None:
    """Write the merged state up to a batch as that batch of a new root. Later batches are then
    appended to the new root."""
    for table in TABLES:
        append_changes(read_stored(spark, root, table, upto + 1), target, table, upto)


def merge_committed(spark: SparkSession, root: str, every: int) -> bool:
    """Merge all committed batches of a store when there are ``every`` or more; whether it was done.

    The number of folders that a reader opens stays below ``every`` per table, however long the stream
    runs. A merge that is cut off leaves the batches as they are and is done anew.
    """
    log = Commits(spark, root)
    batches = log.batches()
    if len(batches) < every:
        return False
    last = batches[-1]
    for table in TABLES:
        append_changes(read_stored(spark, root, table), log.base_root, table, last)
    for table, schema in SIDE_TABLES.items():
        append_changes(log.read(table, schema).drop("batch"), log.base_root, table, last)
    log.commit_base(last, [*TABLES, *SIDE_TABLES])
    return True
