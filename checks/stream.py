"""Streaming forms run to the end of their input and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import plain, query, table
from orelode.session import work_folder
from orelode.streaming import feeds


def event_stream(spark, sf):
    """The event file or folder as a stream of files."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf}/events.parque[t]")


NEWEST = """SELECT user_id, event_type AS status, value, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""


@query("stream_upsert_compacted", NEWEST)
def stream_upsert_compacted(spark, sf):
    """The changes in five files, a micro-batch each; every two batches become a base."""
    folder, source = work_folder(spark, "compacted"), work_folder(spark, "changes")
    changes = table(spark, sf, "events").select("user_id", F.col("event_type").alias("status"), "value", "event_id")
    changes.repartition(5, "event_id").write.parquet(source)
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(source)
    feeds.upsert_stream(stream, folder, ["user_id"], "event_id", compact_after=2).awaitTermination()
    return feeds.current_rows(spark, folder, ["user_id"], "event_id")


@query("stream_upsert", NEWEST)
def stream_upsert(spark, sf):
    folder = work_folder(spark, "upsert")
    changes = event_stream(spark, sf).select("user_id", F.col("event_type").alias("status"), "value", "event_id")
    feeds.upsert_stream(changes, folder, ["user_id"], "event_id").awaitTermination()
    return feeds.current_rows(spark, folder, ["user_id"], "event_id")


@query("stream_once_only", "SELECT DISTINCT 'u' || user_id || event_type AS video_id FROM events")
def stream_once_only(spark, sf):
    folder = work_folder(spark, "once")
    named = event_stream(spark, sf).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.col("event_type")).alias("video_id"),
        F.col("ts").cast("timestamp").alias("seen_at"))
    feeds.append_stream(feeds.once_only(named, "seen_at", "60 days"), folder).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("video_id")


def scored(spark, sf):
    mood = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return event_stream(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", mood.alias("score"))


# In append mode a window is written once the watermark has passed its end, so the
# windows that the last event does not close stay open.
@query("stream_mentions_daily", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%SZ') AS window_start, event_type,
  count(*) AS mentions, round(avg(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END), 6) AS mean_score
FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL""")
def stream_mentions_daily(spark, sf):
    folder = work_folder(spark, "daily")
    counts = feeds.windowed_counts(scored(spark, sf), "ts", "1 hour", "1 day", None, "event_type")
    feeds.append_stream(counts, folder).awaitTermination()
    return plain(spark.read.parquet(f"{folder}/rows").select("window_start", "event_type", "mentions", "mean_score"))


@query("stream_mentions_sliding", """WITH w AS (
  SELECT date_trunc('day', ts) + to_hours(12 * k) AS window_start, event_type, ts FROM events, (SELECT unnest([-1, 0, 1]) AS k)
  WHERE ts >= date_trunc('day', ts) + to_hours(12 * k) AND ts < date_trunc('day', ts) + to_hours(12 * k + 24))
SELECT strftime(window_start, '%Y-%m-%dT%H:%M:%SZ') AS window_start, event_type, count(*) AS mentions,
  round(avg(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END), 6) AS mean_score
FROM w WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL""")
def stream_mentions_sliding(spark, sf):
    folder = work_folder(spark, "sliding")
    counts = feeds.windowed_counts(scored(spark, sf), "ts", "1 hour", "1 day", "12 hours", "event_type")
    feeds.append_stream(counts, folder).awaitTermination()
    return plain(spark.read.parquet(f"{folder}/rows").select("window_start", "event_type", "mentions", "mean_score"))


@query("stream_freshness", """SELECT event_type AS feed, count(*) AS row_count, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS latest_data_at
FROM events GROUP BY event_type""")
def stream_freshness(spark, sf):
    folder = work_folder(spark, "fresh")
    feeds.freshness_stream(event_stream(spark, sf), folder, "event_type", "ts").awaitTermination()
    return plain(feeds.current_rows(spark, folder, ["feed"], "latest_data_at"))
