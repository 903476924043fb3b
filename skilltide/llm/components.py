"""Connected components without a driver-side union-find."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skilltide.storage import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (u, v: long); the root is the smallest node reached.

    Alternates large-star and small-star steps: each links every neighbour of a node to the smallest
    one, so a hub with a third of all nodes is a partial minimum and never a list. Every round is
    written, and the number of rounds grows with the logarithm of the longest path. It ends when every
    node with a smaller neighbour has no other, that is when all are stars.
    """
    links = settle(edges.where("u <> v").select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), "links")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settle(both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")).select(
            "u", F.least("u", "low").alias("m"), "high"), "lowest")
        if not low.where("m < u AND m < high").count():
            return low.select(F.col("u").alias("node"), F.col("m").alias("root"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u <> v")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        # small star: every smaller neighbour of v, and v itself, hang on the smallest
        small = large.join(least, "v").select("u", "v", "m")
        links = settle(small.select(F.col("m").alias("u"), "v").unionByName(
            small.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct(),
            "links")
