"""Search pages: nested JSON in, one row per found repository out."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import NODE, PAGE


class RoutedPages(NamedTuple):
    results: DataFrame
    errors: DataFrame
    failures: DataFrame


def read_pages(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of page texts from a landing folder, one JSON page per line."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def route_response(value: Column) -> Column:
    """'result' when the response holds a search, 'error' when it holds errors, else 'failure'."""
    return (
        F.when(F.get_json_object(value, "$.data.search").isNotNull(), "result")
        .when(F.get_json_object(value, "$.errors").isNotNull(), "error")
        .otherwise("failure")
    )


def route_pages(responses: DataFrame, col: str = "value") -> RoutedPages:
    """Split raw responses into result pages, error texts and responses that hold neither."""
    value = F.col(col)
    routed = responses.withColumn("_route", route_response(value))

    def pick(route: str, text: Column) -> DataFrame:
        return routed.filter(F.col("_route") == route).drop("_route").withColumn(col, text)

    return RoutedPages(
        pick("result", F.get_json_object(value, "$.data.search")),
        pick("error", F.get_json_object(value, "$.errors")),
        pick("failure", value),
    )


def page_struct(value: Column) -> Column:
    """Page text -> struct. The schema is fixed: an inferred one changes with each batch and
    types an empty list of nodes as strings."""
    return F.from_json(value, PAGE, {"columnNameOfCorruptRecord": "_corrupt_record"})


def parse_pages(pages: DataFrame, col: str = "value") -> DataFrame:
    """One row ``node`` per repository found; pages without nodes give no row."""
    return pages.select(F.explode(page_struct(F.col(col)).getField("nodes")).alias("node"))


def corrupt_pages(pages: DataFrame, col: str = "value") -> DataFrame:
    """Pages that are not valid JSON, kept for inspection instead of being lost."""
    parsed = pages.select(page_struct(F.col(col)).alias("page"))
    return parsed.select(F.col("page._corrupt_record").alias(col)).filter(F.col(col).isNotNull())


def next_cursor(page: Column) -> Column:
    """Cursor of the following page, null on the last one."""
    info = page.getField("pageInfo")
    return F.when(info.getField("hasNextPage"), info.getField("endCursor"))


_ROW = f"STRUCT<kind: STRING, text: STRING, node: {NODE}>"


def parsed_pages(texts: DataFrame, col: str = "value", responses: bool = False) -> DataFrame:
    """(kind, text, node) from one parse of pages, or of raw ``responses``.

    ``node``: a repository that a page lists. ``error`` and ``failure``: responses without a search. ``broken``: pages
    that are not valid JSON, whatever of them could be read; nodes that were read count too. A page
    without nodes is ``empty``, so every text gives a row.
    """
    value = F.col(col)
    route = route_response(value) if responses else F.lit("result")
    body = F.get_json_object(value, "$.data.search") if responses else value
    parsed = texts.select(
        value.alias("text"), route.alias("route"), F.when(route == "result", page_struct(body)).alias("page"),
        # a text that is no error is not parsed for it
        F.when(route == "error", F.get_json_object(value, "$.errors")).alias("errors"))
    broken = F.col("page._corrupt_record").isNotNull()
    other = F.when(broken, "broken").when(F.col("route") != "result", F.col("route")).when(
        F.coalesce(F.size("page.nodes"), F.lit(0)) < 1, "empty")
    shown = F.when(other == "error", F.col("errors")).otherwise(F.col("text"))

    def row(kind: Column, text: Column, node: Column) -> Column:
        return F.struct(kind.alias("kind"), text.alias("text"), node.alias("node"))

    nodes = F.transform("page.nodes", lambda n: row(F.lit("node"), F.lit(None).cast("string"), n))
    rest = F.when(other.isNotNull(), F.array(row(other, shown, F.lit(None).cast(NODE))))
    none = F.array().cast(f"ARRAY<{_ROW}>")
    both = F.concat(F.coalesce(nodes, none), F.coalesce(rest, none))
    return parsed.select(F.explode(both).alias("x")).select("x.*")
