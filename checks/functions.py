"""Single functions on whole tables."""

from pyspark.sql import DataFrame, functions as F

from skilltide.functions import numbers as n
from skilltide.sources.languages import extension, language_of, language_of_source

from .adapters import Data
from .registry import query


@query("""SELECT o_orderkey, datediff('day', CAST(o_orderdate AS DATE), DATE '2001-06-01') AS age,
  lower(o_orderpriority) AS priority, length(o_orderpriority) AS size,
  coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END, '') AS status,
  greatest(o_custkey, o_orderkey) AS larger,
  CAST(round(o_totalprice, 1) AS DOUBLE) AS price
FROM orders""")
def date_and_string_functions(d: Data) -> DataFrame:
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return d.table("orders").select(
        "o_orderkey",
        F.datediff(F.lit("2001-06-01").cast("date"), F.col("o_orderdate").cast("date"))
        .cast("long").alias("age"),
        F.lower("o_orderpriority").alias("priority"),
        F.length("o_orderpriority").cast("long").alias("size"),
        F.coalesce(status, F.lit("")).alias("status"),
        F.greatest("o_custkey", "o_orderkey").alias("larger"),
        F.round("o_totalprice", 1).alias("price"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  greatest(0.0, least(1.0, round(l_discount * 30 - 1, 6))) AS clamped,
  CASE WHEN floor(l_quantity) = 1 THEN 0.0 ELSE round(greatest(
    0.0, 1 - l_linenumber / (floor(l_quantity) - 1)), 6) END AS value,
  CAST(l_linenumber + floor(l_quantity) AS BIGINT) AS total
FROM lineitem""")
def grade_arithmetic(d: Data) -> DataFrame:
    quantity = F.floor("l_quantity").cast("long")
    return d.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        n.clamp01(F.round(F.col("l_discount") * 30 - 1, 6)).alias("clamped"),
        F.round(n.category_value(F.col("l_linenumber"), quantity - 1), 6).alias("value"),
        n.array_sum(F.array(F.col("l_linenumber").cast("long"), F.lit(None).cast("long"), quantity))
        .alias("total"))


@query("""SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN '.c' WHEN 'LARGE' THEN '.cpp'
    WHEN 'PROMO' THEN '.js' ELSE '' END AS extension,
  CASE p_type WHEN 'SMALL' THEN 'C' WHEN 'LARGE' THEN 'C++' WHEN 'PROMO' THEN 'JavaScript' END
    AS language,
  CASE p_type WHEN 'SMALL' THEN 'C' ELSE 'C++' END AS reported
FROM part""")
def file_languages(d: Data) -> DataFrame:
    kind = F.col("p_type")
    path = F.when(kind == "SMALL", "./a.b/x.c").when(kind == "LARGE", "./y.z.cpp").when(
        kind == "PROMO", "./.w.js").when(kind == "MEDIUM", "./.js").otherwise("./a.c/README")
    return d.table("part").select(
        "p_partkey", extension(path).alias("extension"), language_of(path).alias("language"),
        language_of_source(path).alias("reported"))
