"""Run history and table freshness: projections, checks, alerts, summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode import dims
from orelode.functions.keys import filled, integer_or_none, stable_id
from orelode.functions.times import duration_between, hours_since, iso_text, moment, normalize_latest, one_decimal, parse_time
from orelode.operators.ranking import latest_per, top_n_per

NEWEST_FIRST = ["created_at", "id"]


def _newest_first() -> list[Column]:
    return [F.col(c).desc() for c in NEWEST_FIRST]


def on_branch(runs: DataFrame, branch: str) -> DataFrame:
    return runs.filter(F.col("branch") == branch)


def newest_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    """Newest ``n`` runs per workflow, ranked from 1."""
    return top_n_per(runs, ["workflow_file"], _newest_first(), n, keep_rank="run_rank")


def latest_run(runs: DataFrame) -> DataFrame:
    return latest_per(runs, ["workflow_file"], _newest_first())


def latest_success(runs: DataFrame, n: int = 10) -> DataFrame:
    """Newest success among the newest ``n`` runs; an older success does not count."""
    recent = newest_runs(runs, n).filter(F.col("conclusion") == "success")
    return latest_per(recent, ["workflow_file"], [F.col("run_rank")])


def run_status(conclusion: Column, status: Column) -> Column:
    return (
        F.when(conclusion == "success", F.lit("success"))
        .when(conclusion.isin(*dims.FAILED_CONCLUSIONS), F.lit("failed"))
        .otherwise(F.coalesce(F.nullif(status, F.lit("")), F.lit("unknown")))
    )


def project_runs(runs: DataFrame, workflows: DataFrame, branch: str) -> DataFrame:
    """Runs in the shape of the run table."""
    cfg = workflows.select(F.col("file").alias("workflow_file"), F.col("name").alias("job_name"))
    started = F.coalesce(F.col("run_started_at"), F.col("created_at"))
    run_id = F.coalesce(F.col("id").cast("string"), F.lit(""))
    return runs.join(cfg, "workflow_file").select(
        stable_id("run", F.col("workflow_file"), run_id).alias("id"),
        "job_name",
        "workflow_file",
        filled(F.col("name"), F.col("job_name")).alias("workflow_name"),
        run_status(F.col("conclusion"), F.col("status")).alias("status"),
        F.nullif(F.col("conclusion"), F.lit("")).alias("conclusion"),
        started.alias("started_at"),
        F.col("updated_at").alias("finished_at"),
        duration_between(started, F.col("updated_at")).alias("duration_seconds"),
        run_id.alias("run_id"),
        F.col("html_url").alias("run_url"),
        F.lit(branch).alias("branch"),
        F.substring(F.coalesce(F.col("head_sha"), F.lit("")), 1, 40).alias("commit_sha"),
        F.coalesce(F.col("display_title"), F.lit("")).alias("message"),
    )


def run_heads(runs: DataFrame, n: int = 10) -> DataFrame:
    """One row per workflow: its latest run's conclusion and its latest success time.

    Both come from the same ranked rows, so the history is shuffled once.
    """
    ranked = newest_runs(runs.select("workflow_file", "id", "created_at", "updated_at", "conclusion"), n)
    won = F.col("conclusion") == "success"
    return ranked.groupBy("workflow_file").agg(
        F.max(F.when(F.col("run_rank") == 1, F.col("conclusion"))).alias("latest_conclusion"),
        F.min_by(F.when(won, F.col("updated_at")), F.when(won, F.col("run_rank"))).alias("latest_success_at"),
    )


def _outcome(status: str, severity: str, message: Column) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(severity).alias("severity"), message.alias("message"))


def classify_workflow(workflows: DataFrame, heads: DataFrame, as_of) -> DataFrame:
    """One check per configured workflow; the first rule that applies decides."""
    joined = workflows.join(
        heads.withColumnRenamed("workflow_file", "file").withColumn("has_run", F.lit(True)), "file", "left"
    ).withColumn("freshness_hours", hours_since(F.col("latest_success_at"), as_of))
    name, feeds = F.col("name"), F.concat(F.lit(" Feeds: "), F.col("feeds"), F.lit("."))
    age, limit = one_decimal(F.col("freshness_hours")), one_decimal(F.col("threshold_hours"))
    last = F.col("latest_conclusion")
    outcome = (
        F.when(F.col("has_run").isNull(), _outcome("empty", "critical", F.concat(
            F.lit("No GitHub Actions runs were found for "), F.col("file"), F.lit("."))))
        .when(last.isin(*dims.CRITICAL_CONCLUSIONS), _outcome("failed", "critical", F.concat(
            F.lit("Latest run failed for "), name, F.lit("."), feeds)))
        .when(last == "cancelled", _outcome("warning", "warning", F.concat(
            F.lit("Latest run was cancelled for "), name, F.lit("."), feeds)))
        .when(F.col("freshness_hours").isNull(), _outcome("empty", "critical", F.concat(
            F.lit("No successful run found for "), name, F.lit("."), feeds)))
        .when(F.col("freshness_hours") > F.col("threshold_hours"), _outcome("stale", "warning", F.concat(
            F.lit("Last successful "), name, F.lit(" run is "), age, F.lit(" hours old. Threshold: "), limit,
            F.lit(" hours."))))
        .otherwise(_outcome("fresh", "info", F.concat(
            name, F.lit(" is healthy. Last success was "), age, F.lit(" hours ago."))))
    )
    return joined.withColumn("outcome", outcome).select(
        stable_id("check", "workflow", F.col("file")).alias("id"),
        F.concat(name, F.lit(" latest run")).alias("check_name"),
        "category",
        F.col("file").alias("target_name"),
        "outcome.status",
        "outcome.severity",
        F.lit(None).cast("long").alias("row_count"),
        F.col("latest_success_at").alias("latest_data_at"),
        "freshness_hours",
        "threshold_hours",
        "outcome.message",
        moment(as_of).alias("checked_at"),
    )


def alerts_from_checks(checks: DataFrame, workflows: DataFrame, source: str = "github_actions") -> DataFrame:
    """Alert rows for checks that are not at rest."""
    cfg = workflows.select(F.col("file").alias("target_name"), "name")
    title = F.concat(F.col("name"), F.lit(" needs attention"))
    return checks.filter(F.col("severity").isin("warning", "critical")).join(cfg, "target_name").select(
        stable_id("alert", source, title).alias("id"),
        "severity",
        title.alias("title"),
        "message",
        F.lit(source).alias("source"),
        F.lit(None).cast("string").alias("sent_to"),
        F.col("checked_at").alias("sent_at"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
    )


def alert_digest(alerts: DataFrame, heading: Column, order: list[Column], n: int = 12, noun: str = "alerts") -> DataFrame:
    """One row: the first ``n`` alerts as text lines and how many more there are."""
    line = F.concat(F.lit("- "), F.upper("severity"), F.lit(": "), heading, F.lit(" - "), F.col("message"))
    shown = alerts.select(F.struct(*order).alias("place"), line.alias("line")).orderBy("place").limit(n)
    total = alerts.agg(F.count(F.lit(1)).alias("n")).scalar()
    more = F.col("total_alerts") - F.col("shown")
    return (
        shown.agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
            .alias("lines"),
            F.count(F.lit(1)).alias("shown"),
        )
        .withColumn("total_alerts", total)
        .select(
            "total_alerts",
            F.when(more > 0, F.concat(F.col("lines"), F.lit("\n- Plus "), more.cast("string"), F.lit(f" more {noun}.")))
            .otherwise(F.col("lines")).alias("digest"),
        )
    )


def health_summary(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count(F.lit(1)).alias("total_workflows"),
        F.count_if(F.col("status") == "fresh").alias("healthy"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
    )


def table_stats(df: DataFrame, name: str, ts_col: str) -> DataFrame:
    """Row count and newest time of one table, both partial aggregates."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.max(ts_col).cast("timestamp_ntz").alias("newest")
    ).select(F.lit(name).alias("table"), "row_count", iso_text(F.col("newest")).alias("latest_data_at"),
             F.lit(None).cast("string").alias("error"), F.lit(True).alias("captured"))


def all_table_stats(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    parts = [table_stats(df, name, ts) for name, (df, ts) in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


#: Types of which Parquet footers hold a smallest and largest value that Spark takes as they are.
FOOTER_TYPES = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date")
_V1_SOURCES = "spark.sql.sources.useV1SourceList"


def footer_table(spark: SparkSession, path: str, raw: Sequence[str] = ()) -> DataFrame:
    """A Parquet table whose counts, smallest and largest values are taken from the file footers.

    Spark does so for tables of its newer reader only, and where ``spark.sql.parquet.aggregatePushdown`` is on, which
    this turns on for the session. The reader is chosen here, for this table alone. Columns named in ``raw`` are read as
    the 64-bit numbers they are stored as, since Spark takes no largest time from a footer.
    """
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    before = spark.conf.get(_V1_SOURCES)
    spark.conf.set(_V1_SOURCES, ",".join(x for x in before.split(",") if x.strip().lower() != "parquet"))
    try:
        table = spark.read.parquet(path)
        if not raw:
            return table
        schema = ", ".join(f"`{c}` {'bigint' if c in raw else kind}" for c, kind in table.dtypes)
        return spark.read.schema(schema).parquet(path)
    finally:
        spark.conf.set(_V1_SOURCES, before)


def footer_stats(spark: SparkSession, path: str, ts_col: str, unit: str | None = None) -> DataFrame:
    """``row_count, newest`` of a Parquet table from its footers; see ``file_stats``."""
    kind = dict(spark.read.parquet(path).dtypes)[ts_col]
    timed = unit is not None and kind.startswith("timestamp")
    table = footer_table(spark, path, [ts_col] if timed else [])
    count, newest = F.count(F.lit(1)).alias("row_count"), F.max(ts_col).alias("newest")
    if timed:
        seconds = (F.col("newest").cast("decimal(20,0)") / F.lit({"micros": 1_000_000, "millis": 1000}[unit])).cast("decimal(18,6)")
        time = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
        if kind == "timestamp":  # an instant, shown in the zone of the session
            time = F.convert_timezone(F.lit("UTC"), F.current_timezone(), time)
        return table.agg(count, newest).select("row_count", time.alias("newest"))
    if kind in FOOTER_TYPES:
        return table.agg(count, newest).select("row_count", F.col("newest").cast("timestamp_ntz").alias("newest"))
    scanned = spark.read.parquet(path).agg(newest)
    return table.agg(count).select("row_count", F.lit(None).cast("timestamp_ntz").alias("newest")).unionByName(
        scanned.select(F.lit(None).cast("long").alias("row_count"), F.col("newest").cast("timestamp_ntz").alias("newest"))
    ).agg(F.max("row_count").alias("row_count"), F.max("newest").alias("newest"))


def file_stats(spark: SparkSession, path: str, name: str, ts_col: str, unit: str | None = None) -> DataFrame:
    """``table_stats`` of a Parquet table from its footers: no row is read.

    Times take their ``unit``, ``micros`` or ``millis`` as the files store them; without one, and for texts, whose
    footers may hold them cut, rows are counted from the footers and the column alone is scanned for the newest.
    Some files have no statistics for a column, such as those with nulls alone: then the table is scanned. Runs at
    once, as only running shows this; one row goes through the driver.
    """
    def shown(stats: DataFrame) -> DataFrame:
        return stats.select(F.lit(name).alias("table"), "row_count", iso_text(F.col("newest")).alias("latest_data_at"),
                            F.lit(None).cast("string").alias("error"), F.lit(True).alias("captured"))

    try:
        rows = shown(footer_stats(spark, path, ts_col, unit))
        row = rows.first()  # a table without row groups has no count at all
        return spark.createDataFrame([(name, row["row_count"] or 0, *row[2:])], rows.schema)
    except Py4JJavaError as failed:
        if "No min/max found" not in str(failed):
            raise
        return table_stats(spark.read.parquet(path), name, ts_col)


def first_result(payload: Column, field: str) -> Column:
    """A field of the first result row, in any of the three envelope layouts."""
    roots = ("$[0].results[0]", "$.result[0].results[0]", "$.results[0]")
    return F.coalesce(*[F.get_json_object(payload, f"{root}.{field}") for root in roots])


def parse_table_stats(raw: DataFrame) -> DataFrame:
    """Query outputs (``table``, ``payload``, ``error``) to statistics rows."""
    roots = ("$[0].results[0]", "$.result[0].results[0]", "$.results[0]")
    found = F.coalesce(*[F.get_json_object(F.col("payload"), root) for root in roots]).isNotNull()
    error = F.nullif(F.trim(F.col("error")), F.lit(""))
    unusable = F.col("payload").isNotNull() & ~found
    return raw.select(
        "table",
        F.when(error.isNull(), integer_or_none(first_result(F.col("payload"), "row_count"))).alias("row_count"),
        F.when(error.isNull(), normalize_latest(first_result(F.col("payload"), "latest_data_at"))).alias("latest_data_at"),
        error.alias("error"),
        F.col("payload").isNotNull().alias("captured"),
        F.when(unusable, F.lit("No D1 result row found")).alias("parse_error"),
    )


def classify_table(checks: DataFrame, stats: DataFrame, as_of, strict: bool = False, store: str = "d1") -> DataFrame:
    """One check per configured table; the first rule that applies decides.

    A newest time that cannot be read leaves the table fresh, as no age is known;
    ``strict`` makes that a warning.
    """
    if "parse_error" not in stats.columns:
        stats = stats.withColumn("parse_error", F.lit(None).cast("string"))
    joined = checks.join(stats, "table", "left").withColumn(
        "freshness_hours", hours_since(parse_time(F.col("latest_data_at")), as_of))
    label, count = F.col("label"), F.col("row_count").cast("string")
    age = one_decimal(F.col("freshness_hours"))
    latest = F.nullif(F.col("latest_data_at"), F.lit(""))
    outcome = (
        F.when(F.col("error").isNotNull(), _outcome("failed", "critical", F.concat(
            label, F.lit(" table could not be queried. "), F.substring("error", 1, 500))))
        .when(~F.coalesce(F.col("captured"), F.lit(False)), _outcome("failed", "critical", F.concat(
            F.lit("No query output was captured for "), label, F.lit("."))))
        .when(F.col("parse_error").isNotNull(), _outcome("failed", "critical", F.concat(
            label, F.lit(" query output could not be parsed: "), F.col("parse_error"))))
        .when(F.col("row_count").isNull(), _outcome("failed", "critical", F.concat(
            label, F.lit(" row count is unavailable."))))
        .when(F.col("row_count") == 0, _outcome("empty", "critical", F.concat(
            label, F.lit(" table exists but has no rows."))))
        .when(latest.isNull(), _outcome("warning", "warning", F.concat(
            label, F.lit(" has "), count, F.lit(" rows but no latest timestamp was found."))))
        .when(F.col("freshness_hours") > F.col("threshold_hours"), _outcome("stale", "warning", F.concat(
            label, F.lit(" has "), count, F.lit(" rows, but latest data is "), age, F.lit(" hours old."))))
    )
    if strict:
        outcome = outcome.when(F.col("freshness_hours").isNull(), _outcome("warning", "warning", F.concat(
            label, F.lit(" has "), count, F.lit(" rows but no latest timestamp was found."))))
    outcome = outcome.otherwise(_outcome("fresh", "info", F.concat(
        label, F.lit(" is healthy with "), count, F.lit(" rows."))))
    return joined.withColumn("outcome", outcome).select(
        stable_id("check", store, F.col("table")).alias("id"),
        F.concat(label, F.lit(f" {store.upper()} table")).alias("check_name"),
        "category",
        F.col("table").alias("target_name"),
        "outcome.status",
        "outcome.severity",
        "row_count",
        latest.alias("latest_data_at"),
        "freshness_hours",
        "threshold_hours",
        "outcome.message",
        moment(as_of).alias("checked_at"),
    )


def table_summary(checks: DataFrame) -> DataFrame:
    def having(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return checks.agg(
        F.count(F.lit(1)).alias("total_tables"), having("fresh").alias("fresh"), having("empty").alias("empty"),
        having("stale").alias("stale"), having("failed").alias("missing_or_failed"))


# Reads the indexes of the health tables are there for.


def open_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("resolved_at").isNull()).orderBy("severity", F.col("created_at").desc(), "id")


def latest_finished(runs: DataFrame) -> DataFrame:
    """Latest finished run per job."""
    return latest_per(runs.filter(F.col("finished_at").isNotNull()), ["job_name"],
                      [F.col("finished_at").desc(), F.col("id").desc()])


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def recent(df: DataFrame, time_col: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.col(time_col).desc(), F.col(tie)).limit(n)
