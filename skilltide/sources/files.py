"""Repository files as rows (repo_id, repo_name, login, path, size, content)."""

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_repo_files(spark: SparkSession, root: str) -> DataFrame:
    """Unpacked trees ``root/<repo_id>/<login>/<repo_name>/<path...>``, read in parallel."""
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select("path", F.col("length").alias("size"), "content")
    )
    # only the prefix of the root is cut, at its full length: trees may hold folders of its name
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    prefix = system.makeQualified(path).toString().rstrip("/") + "/"
    parts = F.split(F.substring("path", F.lit(len(prefix) + 1), F.length("path")), "/")
    return raw.select(
        F.get(parts, 0).alias("repo_id"),
        F.get(parts, 2).alias("repo_name"),
        F.get(parts, 1).alias("login"),
        F.concat(F.lit("./"), F.array_join(F.slice(parts, 4, F.size(parts)), "/")).alias("path"),
        "size",
        F.expr("CASE WHEN is_valid_utf8(content) THEN CAST(content AS STRING) END").alias("content"),
    )


def cap_repo_size(files: DataFrame, max_bytes: int) -> DataFrame:
    """Files of repositories whose total size is within the cap.

    Sizes are summed per repository with partial sums, so one huge repository costs no more
    than one row per map task.
    """
    small = files.groupBy("repo_id").agg(F.sum("size").alias("_total"))
    return files.join(small.filter(F.col("_total") <= max_bytes), "repo_id", "left_semi")
