"""Chains over a batch keep the driver free of tables that grow with the data."""

import datetime

import pytest
from pyspark.sql import functions as F

from skilltide.plans import standings as plan
from skilltide.sources.pages import read_pages
from skilltide.storage import BROADCAST_BYTES, settle, small_broadcasts
from skilltide.streaming.jobs import DeveloperJob, run_stream

STATIC, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def limits(spark):
    return [spark.conf.get(name, None) for name in (STATIC, MEASURED)]


def test_large_tables_are_not_broadcast(spark, tmp_path):
    """200,000 ids: files below Spark's usual limit, far more as a hash table."""
    ids = settle(spark.range(200_000).select(F.xxhash64("id").alias("user_id")), "ids", str(tmp_path / "ids"))
    few = settle(spark.range(10).select(F.xxhash64("id").alias("user_id")), "few", str(tmp_path / "few"))
    rows = settle(spark.range(2_000_000).select(F.xxhash64("id").alias("user_id")), "rows", str(tmp_path / "rows"))

    def joined(users):
        df = rows.join(users, "user_id", "left_semi")
        return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()

    before = limits(spark)
    assert joined(ids)
    with small_broadcasts(spark):
        assert not joined(ids) and joined(few)
        assert limits(spark) == [str(BROADCAST_BYTES)] * 2
    assert limits(spark) == before


@pytest.mark.parametrize("lower", ["-1", "256k"])
def test_a_lower_limit_stays(spark, lower):
    before = spark.conf.get(STATIC)
    try:
        spark.conf.set(STATIC, lower)
        with small_broadcasts(spark):
            assert limits(spark) == [{"-1": "-1", "256k": "262144"}[lower]] * 2
        assert spark.conf.get(STATIC) == lower and limits(spark)[1] is None
        with pytest.raises(ValueError), small_broadcasts(spark):
            raise ValueError("a chain fails")
        assert spark.conf.get(STATIC) == lower
    finally:
        spark.conf.set(STATIC, before)


def test_standings_broadcast_little(spark, table, tmp_path, monkeypatch):
    seen = []

    def recorded(df, *more):
        seen.append(limits(spark))
        return settle(df, *more)

    monkeypatch.setattr(plan, "settle", recorded)
    day = datetime.datetime(2024, 1, 1)
    one = table(plan.FIGURES, (1, "a", "b", 0.5, day, 3), (2, "c", "d", 0.25, day, 3))
    standings = plan.Standings(spark, str(tmp_path / "s"))
    standings.build(one)
    standings.update(one, one.withColumn("avg_grade", F.col("avg_grade") + 0.125))
    assert len(seen) > 3 and seen == [[str(BROADCAST_BYTES)] * 2] * len(seen)


def test_a_streamed_batch_broadcasts_little(spark, tmp_path):
    seen = []

    class Recording(DeveloperJob):
        def store(self, log, pages, batch_id):
            seen.append(limits(pages.sparkSession))

    job = Recording(str(tmp_path / "stored"), None, None, None, None, None, None, merge_every=None)
    spark.range(1).selectExpr("'{}' AS value").write.text(str(tmp_path / "pages"))
    run_stream(read_pages(spark, str(tmp_path / "pages")), job, str(tmp_path / "c"), None).awaitTermination()
    assert seen == [[str(BROADCAST_BYTES)] * 2]
