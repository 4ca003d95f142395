"""Checks, alerts and table freshness, branch by branch."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orelode import dims
from orelode.operators import health
from orelode.plans import jobs

RUN = ("workflow_file string, id bigint, name string, status string, conclusion string, run_started_at timestamp_ntz, "
       "created_at timestamp_ntz, updated_at timestamp_ntz, html_url string, head_sha string, display_title string, branch string")
AS_OF = "2024-01-10T00:00:00Z"


def run(file, i, conclusion, at, branch="main", status="completed", started=None):
    return (file, i, None, status, conclusion, started, at, at, "u", "s" * 50, None, branch)


def at(day, hour=0):
    return datetime(2024, 1, day, hour)


@pytest.fixture
def runs(spark):
    old = [run("buried", 1, "success", at(1))] + [run("buried", i, None, at(2, i), status="queued") for i in range(2, 13)]
    return spark.createDataFrame([
        run("fresh", 1, "success", at(9)), run("edge", 1, "success", at(8, 18)), run("stale", 1, "success", at(8, 17)),
        run("failed", 1, "success", at(9)), run("failed", 2, "timed_out", at(9, 1)),
        run("cancelled", 1, "success", at(9)), run("cancelled", 2, "cancelled", at(9, 1)),
        run("never", 1, None, at(9)), run("dev", 1, "success", at(9), branch="dev"),
        run("tie", 1, "failure", at(9)), run("tie", 2, "success", at(9)), *old,
    ], RUN)


@pytest.fixture
def config(spark):
    files = ["fresh", "edge", "stale", "failed", "cancelled", "never", "dev", "tie", "buried"]
    return spark.createDataFrame([(f.title(), f, "c", 30.0, "t") for f in files], dims.workflows(spark).schema)


def test_each_rule_of_the_workflow_check(runs, config):
    got = {r["target_name"]: r for r in jobs.feed_health(runs, config, AS_OF).collect()}
    assert {k: (r["status"], r["severity"]) for k, r in got.items()} == {
        "fresh": ("fresh", "info"), "edge": ("fresh", "info"), "stale": ("stale", "warning"),
        "failed": ("failed", "critical"), "cancelled": ("warning", "warning"), "never": ("empty", "critical"),
        "dev": ("empty", "critical"), "tie": ("fresh", "info"),
        "buried": ("empty", "critical"),  # a success before the newest ten runs does not count
    }
    assert got["edge"]["freshness_hours"] == 30.0  # exactly at the threshold is fresh
    assert got["stale"]["message"] == "Last successful Stale run is 31.0 hours old. Threshold: 30.0 hours."
    assert got["dev"]["message"] == "No GitHub Actions runs were found for dev."
    assert got["never"]["message"] == "No successful run found for Never. Feeds: t."
    assert got["failed"]["latest_data_at"] == at(9)
    summary = health.health_summary(jobs.feed_health(runs, config, AS_OF)).first()
    assert tuple(summary) == (9, 3, 2, 4)


def test_runs_use_one_shuffle(runs):
    heads = health.run_heads(runs)
    plan = heads._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_run_projection(spark, config):
    rows = spark.createDataFrame([
        run("fresh", 7, "cancelled", at(9)), run("fresh", 8, "skipped", at(9)), run("fresh", 9, "", at(9), status=""),
    ], RUN)
    got = {r["run_id"]: r for r in health.project_runs(rows, config, "main").collect()}
    assert [got[k]["status"] for k in "789"] == ["failed", "completed", "unknown"]
    assert got["9"]["conclusion"] is None and len(got["7"]["commit_sha"]) == 40
    assert got["7"]["workflow_name"] == "Fresh" and got["7"]["duration_seconds"] == 0


def test_alert_digest_counts_the_rest(spark):
    alerts = spark.createDataFrame([("warning", f"t{i:02d}", "m") for i in range(15)], "severity string, title string, message string")
    row = health.alert_digest(alerts, F.col("title"), [F.col("title")]).first()
    lines = row["digest"].split("\n")
    assert row["total_alerts"] == 15 and len(lines) == 13
    assert lines[0] == "- WARNING: t00 - m" and lines[-1] == "- Plus 3 more alerts."
    few = health.alert_digest(alerts.filter("title < 't02'"), F.col("title"), [F.col("title")]).first()
    assert few["digest"] == "- WARNING: t00 - m\n- WARNING: t01 - m"


def test_each_rule_of_the_table_check(spark):
    config = spark.createDataFrame(
        [(t, "c", "ts", 36.0, t.title()) for t in ("ok", "old", "none", "blank", "junk", "null", "err", "lost", "bad")],
        dims.table_checks(spark).schema)
    row = '{"row_count": %s, "latest_data_at": %s}'
    raw = spark.createDataFrame([
        ("ok", '[{"results": [' + row % ('"12"', '"2024-01-09"') + "]}]", None),
        ("old", '{"result": [{"results": [' + row % ("3", '"2024-01-01T00:00:00+00:00"') + "]}]}", ""),
        ("none", '{"results": [' + row % ("0", "null") + "]}", None),
        ("blank", '{"results": [' + row % ("5", '""') + "]}", None),
        ("junk", '{"results": [' + row % ("5", '"soon"') + "]}", None),
        ("null", '{"results": [' + row % ('"x"', '"2024-01-09"') + "]}", None),
        ("err", '{"results": [' + row % ("5", "null") + "]}", " " + "e" * 600),
        ("bad", "not json", None),
    ], "table string, payload string, error string")
    stats = health.parse_table_stats(raw)
    got = {r["target_name"]: r for r in health.classify_table(config, stats, AS_OF).collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        "ok": "fresh", "old": "stale", "none": "empty", "blank": "warning", "junk": "fresh", "null": "failed",
        "err": "failed", "lost": "failed", "bad": "failed"}
    assert got["ok"]["message"] == "Ok is healthy with 12 rows." and got["ok"]["latest_data_at"] == "2024-01-09T00:00:00Z"
    assert got["old"]["message"] == "Old has 3 rows, but latest data is 216.0 hours old."
    assert got["err"]["message"] == "Err table could not be queried. " + "e" * 500
    assert got["lost"]["message"] == "No query output was captured for Lost."
    strict = {r["target_name"]: r["status"] for r in health.classify_table(config, stats, AS_OF, strict=True).collect()}
    assert strict["junk"] == "warning"
    assert tuple(health.table_summary(health.classify_table(config, stats, AS_OF)).first()) == (9, 2, 1, 1, 4)


def test_constant_tables(spark):
    sizes = [d.count() for d in (
        dims.workflows(spark), dims.table_checks(spark), dims.channels(spark), dims.keyword_tags(spark),
        dims.curated_homepages(spark), dims.curated_homepages(spark, True), dims.known_landing_paths(spark),
        dims.common_landing_paths(spark), dims.terms(spark, dims.LINK_TERMS), dims.terms(spark, dims.NEGATIVE_TERMS))]
    assert sizes == [8, 10, 15, 16, 42, 11, 15, 15, 16, 14]
    assert dims.known_project_paths(spark).select("symbol").distinct().count() == 7


def test_result_does_not_depend_on_partitions(runs, config):
    a = jobs.feed_health(runs.repartition(1), config, AS_OF).orderBy("id").collect()
    b = jobs.feed_health(runs.repartition(16), config, AS_OF).orderBy("id").collect()
    assert a == b


def test_file_stats_come_from_footers(spark, sf, tmp_path):
    from orelode.operators import health

    def plan(table, column, unit):
        stats = health.footer_stats(spark, f"{sf}/{table}.parquet", column, unit)
        return stats._jdf.queryExecution().executedPlan().toString()

    assert "PushedAggregation: [COUNT(*), MAX(o_orderdate)]" in plan("orders", "o_orderdate", "micros")
    assert "PushedAggregation: [COUNT(*), MAX(ts)]" in plan("events", "ts", "micros")
    scanned = plan("events", "ts", None)
    assert "PushedAggregation: [COUNT(*)]" in scanned and "ReadSchema: struct<ts:" in scanned
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")
    rows = [(1, "2024-01-03 04:05:06.789123"), (2, None), (3, "1969-12-31 23:59:59.5")]
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    for part, own in enumerate((rows, [])):
        spark.createDataFrame(own, "id long, d string").selectExpr(
            "id", "cast(d as date) as d", "cast(d as timestamp) as t", "cast(d as timestamp_ntz) as z", "cast(null as date) as n",
            "cast(null as timestamp_ntz) as m", "cast(substr(d, 1, 19) as timestamp) as s").write.parquet(f"{tmp_path}/{part}")
    spark.conf.unset("spark.sql.parquet.outputTimestampType")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        for part in (0, 1):
            path = f"{tmp_path}/{part}"
            for column in "dtznms":
                want = health.table_stats(spark.read.parquet(path), "x", column).collect()
                for unit in (None, "micros"):
                    assert health.file_stats(spark, path, "x", column, unit).collect() == want, (zone, part, column, unit)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
