"""Batches that are stored whole or not at all, their merging, and tables in buckets."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from skilltide.plans.ranking import refresh
from skilltide.schemas import TABLES
from skilltide.sources.bucketed import Bucketed, rows_of_keys, write_bucketed
from skilltide.sources.pages import parsed_pages
from skilltide.storage import SmallFiles, current
from skilltide.streaming import changes
from skilltide.streaming.commits import Commits, id_bits


def repositories(table, *rows):
    return table(TABLES["repositories"].replace("BIGINT", "bigint"), *rows)


def at(day):
    return datetime.datetime(2024, 1, day)


@pytest.fixture
def store(table, tmp_path, spark):
    """A root, and a function that stores a batch of repositories (id, lines, day)."""
    root = str(tmp_path / "store")

    def put(batch, *rows, commit=True):
        found = repositories(table, *[(i, 1, f"n{batch}", n, at(day)) for i, n, day in rows])
        changes.append_changes(found, root, "repositories", batch)
        if commit:
            Commits(spark, root).commit(batch, ["repositories"])
    return root, put


def lines(spark, root, **which):
    return rows_of(changes.read_stored(spark, root, "repositories", **which).select("raw_id", "lines_of_code"))


def test_only_committed_batches_are_read(spark, store):
    root, put = store
    put(0, ("a", 1, 1))
    put(1, ("a", 2, 2), ("b", 3, 2), commit=False)
    assert lines(spark, root) == [("a", 1)]
    put(1, ("a", 4, 2))
    assert lines(spark, root) == [("a", 4)] and lines(spark, root, before=1) == [("a", 1)]
    log = Commits(spark, root)
    assert log.batches() == [0, 1] and log.has(1) and not log.has(2)


def test_a_table_without_folder_and_an_empty_batch(spark, store):
    root, put = store
    put(0, ("a", 1, 1))
    Commits(spark, root).commit(1, [])
    assert changes.read_stored(spark, root, "users").count() == 0 and lines(spark, root) == [("a", 1)]


def test_a_batch_has_one_time(spark, tmp_path):
    log = Commits(spark, str(tmp_path / "s"))
    times = {spark.range(1).select(log.time_of(3, F.current_timestamp()).alias("t")).first()["t"] for _ in range(3)}
    assert len(times) == 1
    assert log.batches() == []


def test_folders_that_cannot_matter_are_not_opened(spark, table, store):
    root, put = store
    for day in range(1, 9):
        put(day, (f"id{day}", day, day), (f"other{day}", day, day))
    log = Commits(spark, root)
    since = int((at(6) - datetime.datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert [f.rpartition("=")[2] for _, f in log.folders("repositories", since=since)] == ["6", "7", "8"]
    wanted = table("repo_id string", ("id7",), (None,), ("nowhere",))
    found = log.folders("repositories", since=since, bits=id_bits(wanted, "repo_id"))
    assert [f.rpartition("=")[2] for _, f in found] == ["7"]
    rows = log.read("repositories", TABLES["repositories"], since=since, bits=id_bits(wanted, "repo_id"))
    assert len(rows.inputFiles()) and all("batch=7" in f for f in rows.inputFiles())
    nothing = log.read("repositories", TABLES["repositories"], bits=0)
    assert nothing.count() == 0 and "batch" in nothing.columns


def test_merging_keeps_the_state_and_bounds_the_folders(spark, store, tmp_path):
    root, put = store
    for batch in range(10):
        put(batch, ("a", batch, 1), (f"b{batch}", batch, 1))
        changes.merge_committed(spark, root, every=3)
        assert len(Commits(spark, root).batches()) < 3
    expected = sorted([("a", 9), *((f"b{b}", b) for b in range(10))])
    assert lines(spark, root) == expected
    folders = [p.name for p in (tmp_path / "store" / "repositories").iterdir() if p.is_dir()]
    bases = [p.name for p in (tmp_path / "store-base" / "repositories").iterdir() if p.is_dir()]
    assert len(folders) <= 6 and len(bases) <= 2
    log = Commits(spark, root)
    assert all(log.has(b) for b in range(10)) and not log.has(10)
    with pytest.raises(ValueError):
        log.folders("repositories", before=1)


def test_a_merge_that_was_cut_off_changes_nothing(spark, store):
    root, put = store
    for batch in range(3):
        put(batch, ("a", batch, 1))
    half = changes.read_stored(spark, root, "repositories")
    changes.append_changes(half.limit(0), Commits(spark, root).base_root, "repositories", 2)
    assert lines(spark, root) == [("a", 2)]
    assert changes.merge_committed(spark, root, every=2) and lines(spark, root) == [("a", 2)]


def test_a_view_is_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "ranks")
    first = refresh(spark.range(3), path)
    second = refresh(spark.range(5), path)
    assert first.count() == 3 and second.count() == 5  # the old folder is still there
    third = refresh(spark.range(7), path)
    assert spark.read.parquet(current(spark, path)).count() == third.count() == 7
    assert len([p for p in (tmp_path / "ranks").iterdir() if p.name.startswith("version")]) == 2


def test_small_files(spark, tmp_path):
    files = SmallFiles(spark, str(tmp_path / "x"))
    assert files.names() == []
    files.write("a.json", {"é": [1]})
    files.write("a.json", {"é": [2]})
    assert files.read("a.json") == {"é": [2]} and [n for n in files.names() if n[0] != "."] == ["a.json"]


def test_buckets_are_pruned(spark, table, tmp_path):
    rows = spark.range(1000).select(F.concat(F.lit("r"), F.col("id") % 100).alias("repo_id"), "id")
    held = write_bucketed(rows, str(tmp_path / "t"), "repo_id", 32)
    keys = table("repo_id string, other string", ("r5", "x"), ("r6", "y"), ("none", "z"))
    got = rows_of_keys(held, keys, "repo_id")
    assert rows_of(got) == rows_of(rows.join(keys.select("repo_id"), "repo_id", "left_semi"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan
    numbers = re.search(r"PartitionFilters: \[_bucket#\d+ IN \(([^)]*)\)", plan)[1].split(",")
    assert 1 <= len(numbers) <= 3
    assert rows_of(held.rows) == rows_of(rows)
    assert rows_of_keys(held, keys.limit(0), "repo_id").count() == 0
    assert rows_of(rows_of_keys(rows, keys, "repo_id")) == rows_of(got)
    renamed = rows_of_keys(held, keys.withColumnRenamed("repo_id", "k"), "repo_id", "k")
    assert rows_of(renamed) == rows_of(got)
    with pytest.raises(ValueError):
        rows_of_keys(Bucketed(spark, held.path, "id", 32), keys, "repo_id")


def test_parsed_pages_loses_no_text(table):
    node = '{"id": "x", "name": "n"}'
    texts = ["{broken", '{"nodes": []}', f'{{"nodes": [{node}, {node}]}}', None, '{"nodes": "text"}']
    got = parsed_pages(table("value string", *[(t,) for t in texts]))
    kinds = rows_of(got.groupBy("kind").count())
    assert kinds == [("broken", 2), ("empty", 2), ("node", 2)]
    responses = [f'{{"data": {{"search": {t}}}}}' for t in texts if t] + ['{"errors": [1]}', '{"data": null}', None, "{x"]
    routed = parsed_pages(table("value string", *[(t,) for t in responses]), responses=True)
    assert rows_of(routed.groupBy("kind").count()) == [
        ("broken", 1), ("empty", 1), ("error", 1), ("failure", 4), ("node", 2)]
    assert routed.filter("kind = 'error'").first()["text"] == "[1]"
