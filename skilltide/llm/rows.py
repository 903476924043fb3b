"""Keys for rows of tables whose ids may be null or repeated."""

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of columns of the same names."""
    condition = left[names[0]].eqNullSafe(right[names[0]])
    for name in names[1:]:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, _id, _text): extra columns, whatever their names, travel inside ``row``."""
    return docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"),
                       F.col(text_col).alias("_text"))


@contextmanager
def filtered_joins(spark: SparkSession) -> Iterator[None]:
    """Run queries with Spark's runtime Bloom filters for joins of any size.

    A shuffled join that looks up some rows of a large table then moves about those rows only. The
    filter has a fixed largest size; beyond it, it lets more rows pass, and the join stays exact. It
    is made only for a side that is a stored table under a comparison.
    """
    prefix = "spark.sql.optimizer.runtime.bloomFilter."
    wanted = {"enabled": "true", "applicationSideScanSizeThreshold": "1MB", "creationSideThreshold": "10GB"}
    before = {k: spark.conf.get(prefix + k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(prefix + k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(prefix + k, v)


def mapped(df: DataFrame, function: Callable[[list], list[tuple]], schema: str,
           value: str = "_text") -> DataFrame:
    """``doc_id`` (from ``_id``) and the columns of ``schema``: one tuple of ``function`` per value.

    ``function`` gets the values of a batch. Ids stay Arrow values and are never numbers of Python or
    pandas, where a batch with a null would make a rounded float of every long.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = function(batch.column(value).to_pylist())
            columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(made)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *columns], ["doc_id", *made.names])

    id_type = df.schema["_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {id_type}, {schema}")
