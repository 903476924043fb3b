"""Where intermediate tables go: the shared folder the cluster names."""

import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BROADCAST_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session may do without that setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # local-cluster has several processes
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="skilltide-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in a folder of the application that can be removed
    when it has ended."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, path: str | None = None, by: str | None = None) -> DataFrame:
    """Write a result and read it back, to a fresh path in the shared folder or to ``path``, whose
    earlier content is replaced; in folders of a column ``by``, if given.

    Cuts the lineage at a place that outlives lost executors, and fixes values that a recomputation
    could change.
    """
    target = path or new_path(df.sparkSession, name)
    writer = (df.hint("rebalance", by) if by else df).write.mode("overwrite" if path else "errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


@contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Run queries that broadcast nothing estimated at more than ``BROADCAST_BYTES``; a lower setting stays.

    The estimate is that of compressed files. What the driver holds of a broadcast table is many times as large,
    a chain of joins has several of them at a time, and those of a chain before go only when the driver
    collects its garbage.
    """
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {name: spark.conf.get(name, None) for name in names}
    usual = spark.conf.get(names[0])  # what holds where nothing was set
    try:
        for name in names:
            spark.conf.set(name, str(min(_bytes(before[name] or usual), BROADCAST_BYTES)))
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _bytes(size: str) -> int:
    """A size as Spark writes it, such as ``10m``, in bytes."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


class SmallFiles:
    """Small JSON files below a folder of any file system Spark knows; each appears whole or not at all."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, self.folder = spark.sparkContext._jvm, folder
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    @property
    def _system(self):
        return self._path().getFileSystem(self._conf)

    def names(self) -> list[str]:
        if not self._system.exists(self._path()):
            return []
        return sorted(f.getPath().getName() for f in self._system.listStatus(self._path()))

    def read(self, name: str) -> dict:
        stream = self._system.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, name: str, content: dict) -> None:
        """Written under another name first, then renamed; an earlier file of the name goes."""
        system, draft = self._system, self._path(f"_{name}-{uuid.uuid4().hex}")
        stream = system.create(draft)
        stream.write(json.dumps(content).encode())
        stream.close()
        if system.exists(self._path(name)):
            system.delete(self._path(name), False)
        if not system.rename(draft, self._path(name)):
            raise OSError(f"cannot write {self.folder}/{name}")

    def drop(self, name: str) -> None:
        """Remove a file or a folder below this one."""
        self._system.delete(self._path(name), True)


def replace(df: DataFrame, path: str) -> DataFrame:
    """Store a view in a new folder below ``path``, then point to it in one rename.

    Readers of the folder before are not disturbed; it goes with the next replacement.
    """
    files = SmallFiles(df.sparkSession, path)
    before = files.read("current.json") if "current.json" in files.names() else {}
    folder = f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    files.write("current.json", {"folder": folder, "before": before.get("folder")})
    if before.get("before"):
        files.drop(before["before"])
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{folder}")


def current(spark: SparkSession, path: str) -> str:
    """The folder that the view stored at ``path`` points to."""
    return f"{path}/{SmallFiles(spark, path).read('current.json')['folder']}"
