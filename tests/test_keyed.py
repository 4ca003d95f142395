from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orelode.operators import keyed

OLD, NOW = datetime(2024, 1, 1), datetime(2024, 1, 2)


@pytest.fixture
def target(spark):
    return spark.createDataFrame(
        [("a", 1, "x", OLD, OLD), ("b", 2, "y", OLD, OLD)],
        "id string, n int, note string, created_at timestamp_ntz, updated_at timestamp_ntz")


def rows(df):
    return {r["id"]: tuple(r)[1:] for r in df.collect()}


def test_upsert_inserts_updates_and_keeps(spark, target):
    batch = spark.createDataFrame([("b", 5, None, 1), ("c", 6, "z", 2), ("c", 7, "last", 3)], "id string, n int, note string, seq int")
    got = keyed.upsert(target, batch, ["id"], NOW, arrival="seq")
    assert got.columns == target.columns
    assert rows(got) == {"a": (1, "x", OLD, OLD), "b": (5, None, OLD, NOW), "c": (7, "last", NOW, NOW)}
    again = keyed.upsert(got, batch, ["id"], NOW, arrival="seq")
    assert rows(again) == rows(got)


def test_upsert_of_an_empty_batch(spark, target):
    assert rows(keyed.upsert(target, target.limit(0).drop("created_at", "updated_at"), ["id"], NOW)) == rows(target)


def test_batch_without_a_column_leaves_it(spark, target):
    batch = spark.createDataFrame([("b", 9), ("d", 4)], "id string, n int")
    assert rows(keyed.upsert(target, batch, ["id"], NOW)) == {
        "a": (1, "x", OLD, OLD), "b": (9, "y", OLD, NOW), "d": (4, None, NOW, NOW)}


def test_alert_is_reopened_and_keeps_its_title(spark):
    schema = ("id string, severity string, title string, message string, source string, sent_to string, "
              "sent_at timestamp_ntz, resolved_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz")
    stored = spark.createDataFrame([("1", "warning", "T", "m", "s", "me", OLD, OLD, OLD, OLD)], schema)
    alerts = spark.createDataFrame([("1", "critical", "New", "m2", "s2", None, NOW, None)], ", ".join(schema.split(", ")[:8]))
    assert rows(keyed.upsert_alerts(stored, alerts, NOW)) == {
        "1": ("critical", "T", "m2", "s", "me", NOW, None, OLD, NOW)}


def test_replace_by_key(spark):
    target = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    batch = spark.createDataFrame([("a", 9), ("c", 4), ("c", 4)], "k string, v int")
    got = sorted(tuple(r) for r in keyed.replace_by_key(target, batch, ["k"]).collect())
    assert got == [("a", 9), ("b", 3), ("c", 4), ("c", 4)]


def test_small_batch_does_not_shuffle_the_target(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select(F.col("id"), F.lit(1).alias("n"), F.lit(OLD).cast("timestamp_ntz").alias("created_at"),
                             F.lit(OLD).cast("timestamp_ntz").alias("updated_at")).write.parquet(path)
    small = str(tmp_path / "b")
    spark.range(10).select("id", F.lit(2).alias("n")).write.parquet(small)
    plan = keyed.upsert(spark.read.parquet(path), spark.read.parquet(small), ["id"], NOW)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 3


def test_repeated_keys_need_an_order(spark, target):
    batch = spark.createDataFrame([("b", 1), ("b", 2)], "id string, n int")
    with pytest.raises(Exception, match="order of arrival"):
        keyed.upsert(target, batch, ["id"], NOW).collect()
