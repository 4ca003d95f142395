"""Keyed writes. The table holds what arrived up to a day, the batch what arrived from a day on."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import plain, query, table
from orelode.operators import keyed
from orelode.session import work_folder
from orelode.sources.parted import PartedTable

NOW = "2024-01-31T00:00:00Z"


def user_state(spark, sf, condition):
    """Newest event per user among the chosen events."""
    return table(spark, sf, "events").filter(condition).groupBy("user_id").agg(
        F.max_by("event_type", "event_id").alias("status"), F.max_by("value", "event_id").alias("value"))


def day(text: str):
    return F.lit(f"{text} 00:00:00").cast("timestamp_ntz")


UPSERTED = """WITH target AS (
  SELECT user_id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS value FROM events
  WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id),
batch AS (
  SELECT user_id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS value FROM events
  WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY user_id)
SELECT coalesce(b.user_id, t.user_id) AS user_id,
  CASE WHEN b.user_id IS NULL THEN t.status ELSE b.status END AS status,
  CASE WHEN b.user_id IS NULL THEN t.value ELSE b.value END AS value,
  CASE WHEN t.user_id IS NULL THEN '2024-01-31T00:00:00Z' ELSE '2024-01-02T00:00:00Z' END AS created_at,
  CASE WHEN b.user_id IS NULL THEN '2024-01-02T00:00:00Z' ELSE '2024-01-31T00:00:00Z' END AS updated_at
FROM target t FULL JOIN batch b ON t.user_id = b.user_id"""


@query("upsert_checks", UPSERTED)
def upsert_checks(spark, sf):
    target = user_state(spark, sf, F.col("ts") < day("2024-01-16")).withColumn(
        "created_at", day("2024-01-02")).withColumn("updated_at", day("2024-01-02"))
    # every event of a user is in the batch; the last to arrive wins
    batch = table(spark, sf, "events").filter(F.col("ts") >= day("2024-01-16")).select(
        "user_id", F.col("event_type").alias("status"), "value", F.col("event_id").alias("arrival"))
    return plain(keyed.upsert(target, batch, ["user_id"], NOW, arrival="arrival"))


@query("parted_upsert", UPSERTED)
def parted_upsert(spark, sf):
    """The same in a table of parts, the second batch given twice, as after a failure."""
    own = "user_id", "status", "value"
    schema = spark.createDataFrame([], user_state(spark, sf, F.lit(True)).select(
        *own, day("2024-01-02").alias("created_at"), day("2024-01-02").alias("updated_at")).schema).schema
    held = PartedTable(spark, work_folder(spark, "parted"), schema, ["user_id"], parts=16)
    held.upsert(user_state(spark, sf, F.col("ts") < day("2024-01-16")), "2024-01-02T00:00:00Z", batch_no=0)
    batch = table(spark, sf, "events").filter(F.col("ts") >= day("2024-01-16")).select(
        "user_id", F.col("event_type").alias("status"), "value", F.col("event_id").alias("arrival"))
    for _ in range(2):
        held.upsert(batch, NOW, arrival="arrival", batch_no=1)
    return plain(held.read())


@query("upsert_alerts_reopen", """WITH target AS (
  SELECT substr(sha1('alert|orders|' || o_custkey), 1, 24) AS id, max(o_orderdate) AS newest, count(*) AS n FROM orders
  WHERE o_orderstatus = 'F' GROUP BY o_custkey),
batch AS (
  SELECT substr(sha1('alert|orders|' || o_custkey), 1, 24) AS id, count(*) AS n FROM orders
  WHERE o_orderstatus <> 'F' GROUP BY o_custkey)
SELECT coalesce(t.id, b.id) AS id,
  CASE WHEN b.id IS NULL THEN 'critical' ELSE 'warning' END AS severity,
  CASE WHEN t.id IS NULL THEN 'open' ELSE 'finished' END AS title,
  CASE WHEN b.id IS NULL THEN t.n || ' finished' ELSE b.n || ' open' END AS message,
  CASE WHEN t.id IS NULL THEN 'open' ELSE 'finished' END AS source,
  CASE WHEN t.id IS NULL THEN NULL ELSE 'desk' END AS sent_to,
  CASE WHEN b.id IS NULL THEN strftime(newest, '%Y-%m-%dT%H:%M:%SZ') ELSE '2024-01-31T00:00:00Z' END AS sent_at,
  CASE WHEN b.id IS NULL THEN strftime(newest, '%Y-%m-%dT%H:%M:%SZ') END AS resolved_at,
  CASE WHEN t.id IS NULL THEN '2024-01-31T00:00:00Z' ELSE strftime(newest, '%Y-%m-%dT%H:%M:%SZ') END AS created_at,
  CASE WHEN b.id IS NULL THEN strftime(newest, '%Y-%m-%dT%H:%M:%SZ') ELSE '2024-01-31T00:00:00Z' END AS updated_at
FROM target t FULL JOIN batch b ON t.id = b.id""")
def upsert_alerts_reopen(spark, sf):
    from orelode.functions.keys import stable_id
    from orelode.functions.times import moment

    orders = table(spark, sf, "orders").withColumn("id", stable_id("alert", "orders", F.col("o_custkey")))
    count = F.count(F.lit(1)).cast("string")
    target = orders.filter(F.col("o_orderstatus") == "F").groupBy("id").agg(
        F.max("o_orderdate").alias("newest"), F.concat(count, F.lit(" finished")).alias("message")).select(
        "id", F.lit("critical").alias("severity"), F.lit("finished").alias("title"), "message",
        F.lit("finished").alias("source"), F.lit("desk").alias("sent_to"), F.col("newest").alias("sent_at"),
        F.col("newest").alias("resolved_at"), F.col("newest").alias("created_at"), F.col("newest").alias("updated_at"))
    alerts = orders.filter(F.col("o_orderstatus") != "F").groupBy("id").agg(
        F.concat(count, F.lit(" open")).alias("message")).select(
        "id", F.lit("warning").alias("severity"), F.lit("open").alias("title"), "message",
        F.lit("open").alias("source"), F.lit(None).cast("string").alias("sent_to"), moment(NOW).alias("sent_at"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"))
    return plain(keyed.upsert_alerts(target, alerts, NOW))


@query("replace_by_key", """WITH batch AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01')
SELECT o_custkey, o_orderkey, o_totalprice FROM orders
WHERE o_orderdate < TIMESTAMP '2001-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM batch)
UNION ALL SELECT o_custkey, o_orderkey, o_totalprice FROM batch""")
def replace_by_key(spark, sf):
    orders = table(spark, sf, "orders")
    columns = ["o_custkey", "o_orderkey", "o_totalprice"]
    target = orders.filter(F.col("o_orderdate") < day("2001-01-01")).select(*columns)
    batch = orders.filter(F.col("o_orderdate") >= day("2001-01-01")).select(*columns)
    return keyed.replace_by_key(target, batch, ["o_custkey"])


@query("batch_symbols", "SELECT DISTINCT o_custkey FROM orders")
def batch_symbols(spark, sf):
    return table(spark, sf, "orders").select("o_custkey").distinct()
