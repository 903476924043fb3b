"""The ranking as stored ranges, of which a batch sorts only those in which somebody moved.

A range holds the developers between two places of the order (grade, update, lines of code, user) with
their position in it. A rank is that position and the sizes of the ranges before, so developers who move in
other ranges change nothing here, and a page deep in the list is read from the one or two ranges that
hold it. A small file names the ranges, from the worst to the best; it is replaced in one rename after the new
ranges are written. What it no longer names goes with the next change.
"""

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..storage import SmallFiles, settle, small_broadcasts
from .ranking import Tables, figures

RANGE_ROWS = 1_000_000
ORDER = ("avg_grade", "updated_by_analyzer", "total_lines_of_code", "user_id")
FIGURES = ("user_id BIGINT, login STRING, full_name STRING, avg_grade DOUBLE, "
           "updated_by_analyzer TIMESTAMP_NTZ, total_lines_of_code BIGINT")
_COLUMNS = [c.split()[0] for c in FIGURES.split(", ")]
_KEY = "STRUCT<g: DOUBLE, t: STRING, n: BIGINT, u: BIGINT>"


def _key() -> Column:
    """The place of a row in the order, in a form that a small file can hold."""
    time = F.date_format("updated_by_analyzer", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.struct(F.col("avg_grade").alias("g"), time.alias("t"), F.col("total_lines_of_code").alias("n"),
                    F.col("user_id").alias("u"))


class Standings:
    """The ranking stored below ``path``, in ranges of about ``range_rows``, at most twice as many."""

    def __init__(self, spark: SparkSession, path: str, range_rows: int = RANGE_ROWS):
        self.spark, self.path, self.range_rows = spark, path, range_rows
        self.files = SmallFiles(spark, path)

    @property
    def _state(self) -> dict:
        return self.files.read("current.json") if "current.json" in self.files.names() else {
            "ranges": [], "stale": []}

    @property
    def ranges(self) -> list[dict]:
        """Folder, rows and first key of each range, from the worst rank to the best."""
        return self._state["ranges"]

    def build(self, rows: DataFrame) -> None:
        """Store the ranking of these ``figures``, whatever was stored."""
        with small_broadcasts(self.spark):
            self._replace(self._laid(settle(rows.select(_COLUMNS), "figures")))

    def _laid(self, rows: DataFrame) -> list[dict]:
        """Write sorted rows in new ranges; the entries of these."""
        total = rows.count()
        if not total:
            return []
        order = [F.col(c) for c in ORDER]
        at = F.monotonically_increasing_id()
        placed = settle(rows.repartitionByRange(-(-total // self.range_rows), *order).sortWithinPartitions(
            *order).withColumn("_at", at), "placed").select(
            *_COLUMNS, (F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias("position"),
            F.shiftright("_at", 33).alias("_range"))
        return self._written(placed, {})

    def _written(self, placed: DataFrame, lows: dict[int, dict]) -> list[dict]:
        """Write rows with ``position`` and ``_range``; entries by range. A range that is there already
        keeps its lower end, unless a row is before it."""
        version = f"version-{uuid.uuid4().hex}"
        name = F.concat(F.lit(f"{version}/_range="), F.col("_range").cast("string"))
        placed.withColumn("range_name", name).write.partitionBy("_range").parquet(f"{self.path}/{version}")
        stored = self.spark.read.schema(f"{FIGURES}, position BIGINT, range_name STRING, _range BIGINT").parquet(
            f"{self.path}/{version}")
        # one row per range
        found = stored.groupBy("_range", "range_name").agg(
            F.count("*").alias("n"), F.to_json(F.min(_key())).alias("low")).collect()
        entries = []
        for r in sorted(found, key=lambda r: r["_range"]):
            first, before = json.loads(r["low"]), lows.get(r["_range"])
            low = min(first, before, key=lambda k: (k["g"], k["t"], k["n"], k["u"])) if before else first
            entries.append({"range": r["_range"], "folder": r["range_name"], "rows": r["n"], "low": low})
        return entries

    def _replace(self, entries: list[dict]) -> None:
        state, used = self._state, {e["folder"] for e in entries}
        for folder in state["stale"]:
            self.files.drop(folder)
        self.files.write("current.json", {
            "ranges": [{k: e[k] for k in ("folder", "rows", "low")} for e in entries],
            "stale": [e["folder"] for e in state["ranges"] if e["folder"] not in used]})

    def _read(self, entries: list[dict], before: list[int]) -> DataFrame:
        """Rows of these ranges with their rank."""
        schema = f"{FIGURES}, position BIGINT, range_name STRING"
        if not entries:
            return self.spark.createDataFrame([], f"{FIGURES}, rank BIGINT, range_name STRING")
        offsets = self.spark.createDataFrame(
            [(e["folder"], n) for e, n in zip(entries, before)], "range_name STRING, _before BIGINT")
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{e['folder']}" for e in entries])
        return rows.join(offsets, "range_name").select(
            *_COLUMNS, (F.col("position") + F.col("_before")).alias("rank"), "range_name")

    def _offsets(self, ranges: list[dict]) -> list[int]:
        before, at = [], 0
        for e in ranges:
            before.append(at)
            at += e["rows"]
        return before

    def rows(self) -> DataFrame:
        """Everybody with their rank; the larger the better."""
        ranges = self.ranges
        return self._read(ranges, self._offsets(ranges)).drop("range_name")

    def page(self, page: int, page_size: int = 20) -> DataFrame:
        """A page from 1 of the best first, from the ranges that hold it."""
        ranges = self.ranges
        before = self._offsets(ranges)
        last = sum(e["rows"] for e in ranges) - (page - 1) * page_size
        first = last - page_size + 1
        held = [(e, n) for e, n in zip(ranges, before) if n < last and n + e["rows"] >= first]
        rows = self._read([e for e, _ in held], [n for _, n in held]).drop("range_name")
        return rows.filter(F.col("rank").between(first, last)).orderBy(F.desc("rank"))

    def merge(self, before: Tables, after: Tables, users: DataFrame) -> None:
        """Take in a batch that changed something of these ``users`` (user_id).

        Their figures are worked out from the tables before and after the batch, so that they equal
        those of a ranking from scratch to the last bit.
        """
        with small_broadcasts(self.spark):
            ids = settle(users.select("user_id").distinct(), "moved-users")
            self.update(figures(before, ids), figures(after, ids))

    def update(self, old: DataFrame, new: DataFrame) -> None:
        """Replace rows of ``figures`` by new ones; users may come or go."""
        with small_broadcasts(self.spark):
            self._update(old, new)

    def _update(self, old: DataFrame, new: DataFrame) -> None:
        state = self.ranges
        old, new = (settle(x.select(_COLUMNS), "moved") for x in (old, new))
        gone, come = old.subtract(new), new.subtract(old)
        if not state:
            self.build(new)
            return
        lows = F.from_json(F.lit(json.dumps([e["low"] for e in state])), f"ARRAY<{_KEY}>")
        # a row belongs to the last range that does not begin behind it, else to the first one
        index = F.greatest(F.size(F.filter(lows, lambda low: low <= _key())) - 1, F.lit(0)).cast("long")
        gone = settle(gone.withColumn("_range", index), "gone")
        come = settle(come.withColumn("_range", index), "come")
        touched = sorted(r[0] for r in gone.select("_range").union(come.select("_range")).distinct().collect())
        if not touched:
            return
        names = self.spark.createDataFrame([(state[i]["folder"], i) for i in touched],
                                           "range_name STRING, _range BIGINT")
        kept = self.spark.read.schema(f"{FIGURES}, position BIGINT, range_name STRING").parquet(
            *[f"{self.path}/{state[i]['folder']}" for i in touched]).join(names, "range_name").join(
            gone.select("user_id"), "user_id", "left_anti")
        rows = kept.select(*_COLUMNS, "_range").unionByName(come)
        position = F.row_number().over(Window.partitionBy("_range").orderBy(*ORDER)).cast("long")
        entries = {e["range"]: e for e in self._written(
            rows.withColumn("position", position), {i: state[i]["low"] for i in touched})}
        kept_ranges = []
        for i, e in enumerate(state):
            if i not in touched:
                kept_ranges.append(e)
            elif i in entries:
                kept_ranges += self._split(entries[i])
        self._replace(kept_ranges)

    def _split(self, entry: dict) -> list[dict]:
        """A range that has grown too large in several."""
        if entry["rows"] <= 2 * self.range_rows:
            return [entry]
        parts = self._laid(self._read([entry], [0]).select(_COLUMNS))
        parts[0]["low"] = entry["low"]
        self.files.drop(entry["folder"])
        return parts
