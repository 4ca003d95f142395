"""Feed health on ``events`` read as run history.

A user is a workflow, an event a run; the customers are the configured
workflows, so most of them never ran. Runs with a small ``k`` are off-branch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import plain, query, table
from orelode.functions.times import iso_text
from orelode.operators import health
from orelode.plans import jobs

AS_OF = "2024-01-31T00:00:00Z"
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.concat(F.lit("wf"), F.col("user_id").cast("string")).alias("workflow_file"),
        F.col("event_id").alias("id"),
        F.when(kind != "view", F.concat(F.lit("run of "), kind)).alias("name"),
        F.when(kind == "click", F.lit("in_progress")).otherwise(F.lit("completed")).alias("status"),
        F.when(kind == "error", F.lit("failure")).when(kind == "signup", F.lit("cancelled"))
        .when(kind != "click", F.lit("success")).alias("conclusion"),
        F.when(kind != "purchase", F.timestamp_add("SECOND", F.lit(5), F.col("ts"))).alias("run_started_at"),
        F.col("ts").alias("created_at"),
        F.timestamp_add("SECOND", F.floor("value").cast("int"), F.col("ts")).alias("updated_at"),
        F.concat(F.lit("https://ci.example/"), F.col("event_id").cast("string")).alias("html_url"),
        F.concat(F.sha1(F.col("event_id").cast("string")), F.lit("ffff")).alias("head_sha"),
        F.col("props").alias("display_title"),
        F.when(F.get_json_object("props", "$.k").cast("int") < 20, F.lit("dev")).otherwise(F.lit("main")).alias("branch"))


def workflows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_name").alias("name"),
        F.concat(F.lit("wf"), F.col("c_custkey").cast("string")).alias("file"),
        F.lower("c_mktsegment").alias("category"),
        (F.lit(6.0) + F.col("c_nationkey")).alias("threshold_hours"),
        F.col("c_mktsegment").alias("feeds"))


RUNS = """runs AS (
  SELECT 'wf' || user_id AS workflow_file, event_id AS id,
         CASE WHEN event_type <> 'view' THEN 'run of ' || event_type END AS name,
         CASE WHEN event_type = 'click' THEN 'in_progress' ELSE 'completed' END AS status,
         CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'cancelled' WHEN 'click' THEN NULL
              ELSE 'success' END AS conclusion,
         CASE WHEN event_type <> 'purchase' THEN ts + INTERVAL 5 SECOND END AS run_started_at,
         ts AS created_at, ts + to_seconds(CAST(floor(value) AS BIGINT)) AS updated_at,
         'https://ci.example/' || event_id AS html_url, sha1(CAST(event_id AS VARCHAR)) || 'ffff' AS head_sha,
         props AS display_title,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) < 20 THEN 'dev' ELSE 'main' END AS branch
  FROM events)"""

WORKFLOWS = """cfg AS (
  SELECT c_name AS name, 'wf' || c_custkey AS file, lower(c_mktsegment) AS category,
         6.0::DOUBLE + c_nationkey AS threshold_hours, c_mktsegment AS feeds FROM customer)"""

RANKED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY workflow_file ORDER BY created_at DESC, id DESC) AS run_rank
  FROM runs WHERE branch = 'main')"""

ISO = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
ONE = "CAST(CAST({} AS DECIMAL(18,1)) AS VARCHAR)"

CHECKS = f"""{RUNS}, {WORKFLOWS}, {RANKED},
heads AS (
  SELECT workflow_file, max(CASE WHEN run_rank = 1 THEN conclusion END) AS latest_conclusion,
         arg_min(updated_at, run_rank) FILTER (WHERE conclusion = 'success') AS latest_success_at
  FROM ranked WHERE run_rank <= 10 GROUP BY workflow_file),
aged AS (
  SELECT c.*, h.workflow_file IS NOT NULL AS has_run, latest_conclusion AS last, latest_success_at AS ok_at,
         round(greatest(0.0, date_diff('microsecond', latest_success_at, {AS_OF_SQL}) / 3.6e9), 2) AS age
  FROM cfg c LEFT JOIN heads h ON h.workflow_file = c.file),
judged AS (
  SELECT *, CASE WHEN ok_at IS NULL THEN NULL ELSE age END AS hours,
    CASE WHEN NOT has_run THEN 1 WHEN last IN ('failure', 'timed_out', 'action_required') THEN 2
         WHEN last = 'cancelled' THEN 3 WHEN ok_at IS NULL THEN 4 WHEN age > threshold_hours THEN 5 ELSE 6 END AS rule
  FROM aged),
checks AS (
  SELECT substr(sha1('check|workflow|' || file), 1, 24) AS id, name || ' latest run' AS check_name, category,
    file AS target_name, name AS job,
    ['empty', 'failed', 'warning', 'empty', 'stale', 'fresh'][rule] AS status,
    ['critical', 'critical', 'warning', 'critical', 'warning', 'info'][rule] AS severity,
    CAST(NULL AS BIGINT) AS row_count, {ISO.format('ok_at')} AS latest_data_at, hours AS freshness_hours,
    threshold_hours,
    CASE rule WHEN 1 THEN 'No GitHub Actions runs were found for ' || file || '.'
      WHEN 2 THEN 'Latest run failed for ' || name || '. Feeds: ' || feeds || '.'
      WHEN 3 THEN 'Latest run was cancelled for ' || name || '. Feeds: ' || feeds || '.'
      WHEN 4 THEN 'No successful run found for ' || name || '. Feeds: ' || feeds || '.'
      WHEN 5 THEN 'Last successful ' || name || ' run is ' || {ONE.format('hours')} || ' hours old. Threshold: '
                  || {ONE.format('threshold_hours')} || ' hours.'
      ELSE name || ' is healthy. Last success was ' || {ONE.format('hours')} || ' hours ago.' END AS message,
    '2024-01-31T00:00:00Z' AS checked_at
  FROM judged)"""

ALERTS = f"""{CHECKS},
alerts AS (
  SELECT substr(sha1('alert|github_actions|' || job || ' needs attention'), 1, 24) AS id, severity,
    job || ' needs attention' AS title, message, 'github_actions' AS source, CAST(NULL AS VARCHAR) AS sent_to,
    checked_at AS sent_at, CAST(NULL AS VARCHAR) AS resolved_at
  FROM checks WHERE severity IN ('warning', 'critical'))"""

_HEAD_COLUMNS = ["workflow_file", "id", "created_at", "updated_at", "conclusion"]
_HEAD_SQL = f"workflow_file, id, {ISO.format('created_at')} AS created_at, {ISO.format('updated_at')} AS updated_at, conclusion"


@query("latest_run", f"WITH {RUNS}, {RANKED} SELECT {_HEAD_SQL} FROM ranked WHERE run_rank = 1")
def latest_run(spark, sf):
    return plain(health.latest_run(health.on_branch(runs(spark, sf), "main")).select(*_HEAD_COLUMNS))


@query("latest_success_of_10", f"""WITH {RUNS}, {RANKED}
SELECT {_HEAD_SQL}, run_rank FROM ranked WHERE run_rank <= 10 AND conclusion = 'success'
QUALIFY row_number() OVER (PARTITION BY workflow_file ORDER BY run_rank) = 1""")
def latest_success(spark, sf):
    df = health.latest_success(health.on_branch(runs(spark, sf), "main"), 10)
    return plain(df.select(*_HEAD_COLUMNS, F.col("run_rank").cast("long").alias("run_rank")))


RUN_ROW = f"""SELECT substr(sha1('run|' || workflow_file || '|' || id), 1, 24) AS id, c.name AS job_name, workflow_file,
  coalesce(r.name, c.name) AS workflow_name,
  CASE WHEN conclusion = 'success' THEN 'success'
       WHEN conclusion IN ('failure', 'timed_out', 'cancelled', 'action_required') THEN 'failed'
       ELSE coalesce(status, 'unknown') END AS status, conclusion,
  {ISO.format('coalesce(run_started_at, created_at)')} AS started_at, {ISO.format('updated_at')} AS finished_at,
  greatest(0, date_diff('microsecond', coalesce(run_started_at, created_at), updated_at) // 1000000) AS duration_seconds,
  CAST(id AS VARCHAR) AS run_id, html_url AS run_url, 'main' AS branch, substr(head_sha, 1, 40) AS commit_sha,
  display_title AS message"""


@query("run_projection", f"""WITH {RUNS}, {WORKFLOWS} {RUN_ROW}
FROM runs r JOIN cfg c ON c.file = workflow_file WHERE branch = 'main'""")
def run_projection(spark, sf):
    return plain(health.project_runs(health.on_branch(runs(spark, sf), "main"), workflows(spark, sf), "main"))


@query("feed_job_runs", f"""WITH {RUNS}, {WORKFLOWS}, {RANKED} {RUN_ROW}
FROM ranked r JOIN cfg c ON c.file = workflow_file WHERE run_rank = 1""")
def feed_job_runs(spark, sf):
    return plain(jobs.feed_health_job(runs(spark, sf), workflows(spark, sf), AS_OF).runs)


CHECK_COLUMNS = ("id, check_name, category, target_name, status, severity, row_count, latest_data_at, freshness_hours, "
                 "threshold_hours, message, checked_at")


def checks_of(spark, sf):
    return jobs.feed_health(runs(spark, sf), workflows(spark, sf), AS_OF)


@query("workflow_check", f"WITH {CHECKS} SELECT {CHECK_COLUMNS} FROM checks")
def workflow_check(spark, sf):
    return plain(checks_of(spark, sf))


def alerts_of(spark, sf):
    return health.alerts_from_checks(checks_of(spark, sf), workflows(spark, sf))


@query("workflow_alerts", f"WITH {ALERTS} SELECT * FROM alerts")
def workflow_alerts(spark, sf):
    return plain(alerts_of(spark, sf))


@query("alert_digest", f"""WITH {ALERTS},
numbered AS (SELECT *, row_number() OVER (ORDER BY title) AS rn, count(*) OVER () AS total FROM alerts)
SELECT max(total) AS total_alerts,
  string_agg('- ' || upper(severity) || ': ' || title || ' - ' || message, chr(10) ORDER BY rn)
  || CASE WHEN max(total) > 12 THEN chr(10) || '- Plus ' || (max(total) - 12) || ' more alerts.' ELSE '' END AS digest
FROM numbered WHERE rn <= 12""")
def alert_digest(spark, sf):
    return health.alert_digest(alerts_of(spark, sf), F.col("title"), [F.col("title")])


@query("health_summary", f"""WITH {CHECKS}
SELECT count(*) AS total_workflows, count(*) FILTER (WHERE status = 'fresh') AS healthy,
  count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'critical') AS critical
FROM checks""")
def health_summary(spark, sf):
    return health.health_summary(checks_of(spark, sf))


# Table freshness. The monitored tables are events, orders and lineitem, and an
# events view without rows; the tables to check are the feeds named below.

TABLES = [
    ("events", "market", "ts", 36.0, "Events"),
    ("orders", "news", "o_orderdate", 72.0, "Orders"),
    ("lineitem", "news", "l_shipdate", 168.0, "Line items"),
    ("refunds", "news", "ts", 72.0, "Refunds"),
    ("documents", "company_web", "ts", 72.0, "Documents"),
]
TABLES_SQL = "VALUES " + ", ".join(f"('{t}', '{c}', {h}::DOUBLE, '{label}')" for t, c, _, h, label in TABLES)


def monitored(spark, sf):
    events = table(spark, sf, "events")
    return health.all_table_stats({
        "events": (events, "ts"),
        "orders": (table(spark, sf, "orders"), "o_orderdate"),
        "lineitem": (table(spark, sf, "lineitem"), "l_shipdate"),
        "refunds": (events.filter(F.col("event_type") == "refund"), "ts"),
    })


def table_config(spark):
    return spark.createDataFrame(
        TABLES, "table string, category string, latest_column string, threshold_hours double, label string")


STATS = f"""stats AS (
  SELECT 'events' AS tbl, count(*) AS row_count, max(ts) AS newest FROM events
  UNION ALL SELECT 'orders', count(*), max(o_orderdate) FROM orders
  UNION ALL SELECT 'lineitem', count(*), max(l_shipdate) FROM lineitem
  UNION ALL SELECT 'refunds', count(*), max(ts) FROM events WHERE event_type = 'refund')"""

TABLE_CHECK = f"""{STATS}, cfg(tbl, category, threshold_hours, label) AS ({TABLES_SQL}),
aged AS (
  SELECT c.*, s.tbl IS NOT NULL AS captured, row_count, date_trunc('second', newest) AS newest,
    round(greatest(0.0, date_diff('microsecond', date_trunc('second', newest), {AS_OF_SQL}) / 3.6e9), 2) AS age
  FROM cfg c LEFT JOIN stats s USING (tbl)),
judged AS (
  SELECT *, CASE WHEN newest IS NULL THEN NULL ELSE age END AS hours,
    CASE WHEN NOT captured THEN 1 WHEN row_count IS NULL THEN 2 WHEN row_count = 0 THEN 3 WHEN newest IS NULL THEN 4
         WHEN age > threshold_hours THEN 5 ELSE 6 END AS rule FROM aged),
checks AS (
  SELECT substr(sha1('check|d1|' || tbl), 1, 24) AS id, label || ' D1 table' AS check_name, category,
    tbl AS target_name, ['failed', 'failed', 'empty', 'warning', 'stale', 'fresh'][rule] AS status,
    ['critical', 'critical', 'critical', 'warning', 'warning', 'info'][rule] AS severity, row_count,
    {ISO.format('newest')} AS latest_data_at, hours AS freshness_hours, threshold_hours,
    CASE rule WHEN 1 THEN 'No query output was captured for ' || label || '.'
      WHEN 2 THEN label || ' row count is unavailable.' WHEN 3 THEN label || ' table exists but has no rows.'
      WHEN 4 THEN label || ' has ' || row_count || ' rows but no latest timestamp was found.'
      WHEN 5 THEN label || ' has ' || row_count || ' rows, but latest data is ' || {ONE.format('hours')} || ' hours old.'
      ELSE label || ' is healthy with ' || row_count || ' rows.' END AS message, '2024-01-31T00:00:00Z' AS checked_at
  FROM judged)"""


@query("table_stats", f"WITH {STATS} SELECT tbl AS name, row_count, {ISO.format('newest')} AS latest_data_at FROM stats")
def table_stats(spark, sf):
    return monitored(spark, sf).select(F.col("table").alias("name"), "row_count", "latest_data_at")


@query("file_stats", f"WITH {STATS} SELECT tbl AS name, row_count, {ISO.format('newest')} AS latest_data_at FROM stats WHERE tbl <> 'refunds'")
def file_stats(spark, sf):
    times = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}
    parts = [health.file_stats(spark, f"{sf}/{t}.parquet", t, c, "micros") for t, c in times.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(F.col("table").alias("name"), "row_count", "latest_data_at")


@query("table_check", f"WITH {TABLE_CHECK} SELECT * FROM checks")
def table_check(spark, sf):
    return plain(health.classify_table(table_config(spark), monitored(spark, sf), AS_OF))


@query("table_summary", f"""WITH {TABLE_CHECK} SELECT count(*) AS total_tables,
  count(*) FILTER (WHERE status = 'fresh') AS fresh, count(*) FILTER (WHERE status = 'empty') AS empty,
  count(*) FILTER (WHERE status = 'stale') AS stale, count(*) FILTER (WHERE status = 'failed') AS missing_or_failed
FROM checks""")
def table_summary(spark, sf):
    return health.table_summary(health.classify_table(table_config(spark), monitored(spark, sf), AS_OF))


@query("table_job_alerts", f"""WITH {TABLE_CHECK} SELECT substr(sha1('alert|d1|' || label || ' needs attention'), 1, 24) AS id,
  severity, label || ' needs attention' AS title, message, 'd1' AS source, CAST(NULL AS VARCHAR) AS sent_to,
  checked_at AS sent_at, CAST(NULL AS VARCHAR) AS resolved_at
FROM checks JOIN cfg ON tbl = target_name WHERE severity IN ('warning', 'critical')""")
def table_job_alerts(spark, sf):
    return plain(jobs.table_health_job(table_config(spark), monitored(spark, sf), AS_OF).alerts)


# Statistics of each user's events, written in the three envelope layouts by
# favourite event type, and as an error text for one of them.

def outputs(spark, sf):
    per_user = table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("newest"), F.max_by("event_type", "event_id").alias("kind"))
    row = F.format_string('{"row_count": %d, "latest_data_at": "%s"}', F.col("n"), F.date_format("newest", "yyyy-MM-dd"))
    kind = F.col("kind")
    payload = (
        F.when(kind == "view", F.concat(F.lit('[{"results": ['), row, F.lit("]}]")))
        .when(kind == "click", F.concat(F.lit('{"result": [{"results": ['), row, F.lit("]}]}")))
        .when(kind == "signup", F.concat(F.lit('{"results": ['), row, F.lit("]}")))
        .when(kind == "purchase", F.lit('{"results": []}'))
    )
    return per_user.select(
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("table"), payload.alias("payload"),
        F.when(kind == "error", F.concat(F.lit(" no such table: t"), F.col("user_id").cast("string"))).alias("error"))


@query("table_stats_envelope", """WITH per_user AS (
  SELECT user_id, count(*) AS n, max(ts) AS newest, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id)
SELECT 't' || user_id AS name,
  CASE WHEN kind IN ('view', 'click', 'signup') THEN n END AS row_count,
  CASE WHEN kind IN ('view', 'click', 'signup') THEN strftime(newest, '%Y-%m-%d') || 'T00:00:00Z' END AS latest_data_at,
  CASE WHEN kind = 'error' THEN 'no such table: t' || user_id END AS error, kind <> 'error' AS captured,
  CASE WHEN kind = 'purchase' THEN 'No D1 result row found' END AS parse_error
FROM per_user""")
def table_stats_envelope(spark, sf):
    return health.parse_table_stats(outputs(spark, sf)).withColumnRenamed("table", "name")


# Reads by index.

@query("open_alerts", f"""WITH {ALERTS} SELECT a.id, severity, title, o.opened AS created_at FROM alerts a
JOIN (SELECT c_name || ' needs attention' AS title, {ISO.format('min(o_orderdate)')} AS opened,
             max(o_orderstatus) AS worst FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_name) o USING (title)
WHERE worst <> 'P'""")
def open_alerts(spark, sf):
    alerts = alerts_of(spark, sf).drop("resolved_at")
    customers = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(" needs attention")).alias("title"))
    opened = table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("title").agg(
        F.min("o_orderdate").alias("created_at"), F.max("o_orderstatus").alias("worst"))
    # alerts of customers whose last order status is P count as resolved
    stored = alerts.join(opened, "title").withColumn(
        "resolved_at", F.when(F.col("worst") == "P", F.col("created_at")))
    return health.open_alerts(stored).select("id", "severity", "title", iso_text(F.col("created_at")).alias("created_at"))


@query("latest_finished", f"""WITH {RUNS}, {WORKFLOWS}
SELECT c.name AS job_name, substr(sha1('run|' || workflow_file || '|' || id), 1, 24) AS id,
  {ISO.format('updated_at')} AS finished_at
FROM runs r JOIN cfg c ON c.file = workflow_file
QUALIFY row_number() OVER (PARTITION BY c.name ORDER BY updated_at DESC, substr(sha1('run|' || workflow_file || '|' || id), 1, 24) DESC) = 1""")
def latest_finished(spark, sf):
    projected = health.project_runs(runs(spark, sf), workflows(spark, sf), "main")
    return plain(health.latest_finished(projected).select("job_name", "id", "finished_at"))


@query("status_counts", f"""WITH {RUNS}, {WORKFLOWS}
SELECT CASE WHEN conclusion = 'success' THEN 'success'
       WHEN conclusion IN ('failure', 'timed_out', 'cancelled', 'action_required') THEN 'failed'
       ELSE coalesce(status, 'unknown') END AS status, conclusion, count(*) AS n
FROM runs r JOIN cfg c ON c.file = workflow_file GROUP BY ALL""")
def status_counts(spark, sf):
    return health.count_by(health.project_runs(runs(spark, sf), workflows(spark, sf), "main"), "status", "conclusion")


@query("check_counts", f"WITH {CHECKS} SELECT status, severity, count(*) AS n FROM checks GROUP BY ALL")
def check_counts(spark, sf):
    return health.count_by(checks_of(spark, sf), "status", "severity")


@query("recent_checks", f"""WITH {RUNS} SELECT workflow_file, id, {ISO.format('updated_at')} AS checked_at
FROM runs ORDER BY updated_at DESC, id LIMIT 50""")
def recent_checks(spark, sf):
    checked = runs(spark, sf).select("workflow_file", "id", F.col("updated_at").alias("checked_at"))
    return plain(health.recent(checked, "checked_at", "id", 50))
