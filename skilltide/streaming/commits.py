"""Which batches of a store are there: all tables of a batch, or none.

A batch writes its rows to one folder per table (``changes``) and then, in one rename, a small file next to
the store that names the tables. Readers open the folders of committed batches only, so a batch that
was cut off between two tables is not seen until it has been repeated. The file also tells what the folder of
repositories holds, so that a reader who looks for some of them does not open it in vain.

Every so many batches the committed ones are merged into one folder per table, and a file that replaces
theirs points to it. The folders it stands for go when the next such file is written, since readers
may still be in them until then.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import TABLES
from ..storage import SmallFiles

ID_BITS = 1 << 15


def id_bit(key: Column) -> Column:
    """The bit that an id sets in a filter of ``ID_BITS`` bits."""
    return F.pmod(F.xxhash64(key), F.lit(ID_BITS)).cast("int")


def id_bits(ids: DataFrame, column: str) -> int:
    """All bits that the ids set, as one number. At most ``ID_BITS`` rows reach the driver."""
    found = ids.select(id_bit(F.col(column)).alias("bit")).distinct().collect()
    return sum(1 << r["bit"] for r in found if r["bit"] is not None)


class Commits:
    """The commit files of the store at ``root``, in the folder beside it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.base_root = f"{root}-base"
        self.files = SmallFiles(spark, f"{root}-commits")

    def exists(self) -> bool:
        return bool(self.files.names())

    def _numbers(self, kind: str) -> list[int]:
        ending = f".{kind}.json"
        return sorted(int(n.removesuffix(ending)) for n in self.files.names()
                      if n.endswith(ending) and n[0] != "_")

    def base(self) -> int | None:
        """The last batch of the newest merged state."""
        return max(self._numbers("base"), default=None)

    def batches(self) -> list[int]:
        """Committed batches that are not merged yet."""
        base = self.base()
        return [b for b in self._numbers("batch") if base is None or b > base]

    def has(self, batch_id: int) -> bool:
        base = self.base()
        return base is not None and batch_id <= base or batch_id in self._numbers("batch")

    def time_of(self, batch_id: int, now: Column) -> Column:
        """The time of a batch, the same in every table and when the batch is repeated."""
        name = f"{batch_id}.time.json"
        if name not in self.files.names():
            row = self.spark.range(1).select(F.unix_micros(now.cast("timestamp")).alias("now")).first()
            self.files.write(name, {"micros": row["now"]})
        return F.timestamp_micros(F.lit(self.files.read(name)["micros"]))

    def commit(self, batch_id: int, tables: Iterable[str], counts: dict | None = None) -> None:
        """Make the folders of a batch visible."""
        content = {"tables": sorted(tables), "counts": counts or {}}
        if "repositories" in content["tables"]:
            content |= self._held(f"{self.root}/repositories/batch={batch_id}")
        self.files.write(f"{batch_id}.batch.json", content)

    def _held(self, folder: str) -> dict:
        """The latest time and the id filter of a folder of repositories."""
        rows = self.spark.read.schema(TABLES["repositories"]).parquet(folder)
        latest = rows.agg(F.max(F.unix_micros(F.col("updated_by_analyzer").cast("timestamp"))).alias("t")).first()
        return {"latest": latest["t"], "bits": f"{id_bits(rows, 'raw_id'):x}"}

    def counts(self) -> dict[int, dict]:
        """What each batch that is not merged yet has counted."""
        return {b: self.files.read(f"{b}.batch.json")["counts"] for b in self.batches()}

    def folders(self, table: str, before: int | None = None, since: int | None = None,
                bits: int | None = None) -> list[tuple[str, str]]:
        """(base path, folder) of the committed rows of a table.

        ``since`` (microseconds) leaves out folders whose repositories are all older, ``bits`` those
        that hold none of the ids that set them.
        """
        base, found = self.base(), []
        if base is not None and before is not None and before <= base:
            raise ValueError(f"batches up to {base} are merged, so the state before {before} is gone")
        named = [] if base is None else [(self.base_root, f"batch={base}", f"{base}.base.json")]
        named += [(self.root, f"batch={b}", f"{b}.batch.json") for b in self.batches()
                  if before is None or b < before]
        for root, folder, name in named:
            content = self.files.read(name)
            old = since is not None and (content.get("latest") is None or content["latest"] < since)
            other = bits is not None and not bits & int(content.get("bits", "0"), 16)
            if table in content["tables"] and not old and not other:
                found.append((f"{root}/{table}", f"{root}/{table}/{folder}"))
        return found

    def read(self, table: str, schema: str, **which) -> DataFrame:
        """Committed rows of a table with their ``batch``; see ``folders``."""
        full = f"{schema}, batch BIGINT"
        found = self.folders(table, **which)
        rows = None
        for path in sorted({p for p, _ in found}):
            part = self.spark.read.schema(full).option("basePath", path).parquet(
                *[f for p, f in found if p == path])
            rows = part if rows is None else rows.unionByName(part)
        return self.spark.createDataFrame([], full) if rows is None else rows

    def commit_base(self, last: int, tables: Iterable[str]) -> None:
        """Let the merged folders of batches up to ``last`` stand for those batches, and remove what an
        earlier merged state has stood for."""
        before = self.base()
        held = self._held(f"{self.base_root}/repositories/batch={last}")
        self.files.write(f"{last}.base.json", {"tables": sorted(tables)} | held)
        self._drop_merged(before)

    def _drop_merged(self, base: int | None) -> None:
        """Remove the folders that a merged state has replaced: nobody has been sent there since."""
        if base is None:
            return
        gone = [b for b in self._numbers("batch") if b <= base]
        older = [b for b in self._numbers("base") if b < base]
        for root, numbers, kind in ((self.root, gone, "batch"), (self.base_root, older, "base")):
            folders = SmallFiles(self.spark, root)
            tables = folders.names()
            for b in numbers:
                self.files.drop(f"{b}.{kind}.json")
                for table in tables:
                    folders.drop(f"{table}/batch={b}")
        for b in self._numbers("time"):
            if b <= base:
                self.files.drop(f"{b}.time.json")
