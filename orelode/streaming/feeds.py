"""Structured Streaming forms of the batch operators.

A starter returns the running query. Checkpoints and tables lie in folders the
caller names, which all executors must reach.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orelode.operators.keyed import last_per_key
from orelode.operators.ranking import keep_first
from orelode.sources.parted import complete_numbers, delete_folder

BATCH = "batch_no"


def _start(df: DataFrame, folder: str, mode: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return (
        df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).foreachBatch(write).start()
    )


def upsert_stream(changes: DataFrame, folder: str, key: Sequence[str], arrival: str, compact_after: int | None = None) -> StreamingQuery:
    """Keyed upsert of a stream of changes.

    A micro-batch adds its own last row per key and touches nothing else, so its
    cost does not grow with the table. A batch that is run again after a failure
    overwrites the folder of its own number. ``current_rows`` is the table. Once ``compact_after`` batches are open,
    ``compact`` puts them into the base.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        last_per_key(batch.withColumn("arrival_order", F.col(arrival)), key, "arrival_order").write.mode(
            "overwrite").parquet(f"{folder}/changes/{BATCH}={batch_id}")
        if compact_after is not None and len(_open_batches(batch.sparkSession, folder)) >= compact_after:
            compact(batch.sparkSession, folder, key, arrival)

    return _start(changes, folder, "append", write)


def _open_batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the completely written batches that the base does not have."""
    bases = complete_numbers(spark, f"{folder}/base")
    return [n for n in complete_numbers(spark, f"{folder}/changes", f"{BATCH}=") if not bases or n > bases[-1]]


def _all_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The base, if there is one, and the open batches: all that is read, however many batches there were."""
    bases, open_ = complete_numbers(spark, f"{folder}/base"), _open_batches(spark, folder)
    parts = [spark.read.parquet(f"{folder}/base/{bases[-1]}")] if bases else []
    if open_ or not parts:
        paths = [f"{folder}/changes/{BATCH}={n}" for n in open_] or [f"{folder}/changes"]
        parts.append(spark.read.option("basePath", f"{folder}/changes").parquet(*paths))
    return reduce(lambda a, b: a.unionByName(b), (x.withColumn(BATCH, F.col(BATCH).cast("long")) for x in parts))


def current_rows(spark: SparkSession, folder: str, key: Sequence[str], arrival: str) -> DataFrame:
    """Newest row per key over all micro-batches; a late, older change does not win."""
    return keep_first(_all_rows(spark, folder), list(key), [F.col(arrival).desc(), F.col(BATCH).desc()]).drop(BATCH)


def compact(spark: SparkSession, folder: str, key: Sequence[str], arrival: str) -> None:
    """Puts the open batches into a new base, which is named by the last batch it has, and deletes them.

    The base counts once it is completely written; until then the old base and the batches are the table. A batch that
    is run again later does not count, as its number is not above the base's. No reader may be at work on the old files.
    """
    open_ = _open_batches(spark, folder)
    if not open_:
        return
    rows = keep_first(_all_rows(spark, folder), list(key), [F.col(arrival).desc(), F.col(BATCH).desc()])
    rows.write.mode("overwrite").parquet(f"{folder}/base/{open_[-1]}")
    for n in complete_numbers(spark, f"{folder}/base")[:-1]:
        delete_folder(spark, f"{folder}/base/{n}")
    for n in complete_numbers(spark, f"{folder}/changes", f"{BATCH}="):
        if n <= open_[-1]:
            delete_folder(spark, f"{folder}/changes/{BATCH}={n}")


def once_only(videos: DataFrame, time_col: str, lateness: str) -> DataFrame:
    """Videos not seen before, with state kept for ``lateness`` only."""
    return videos.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark(["video_id"])


def append_stream(rows: DataFrame, folder: str) -> StreamingQuery:
    """Append-mode rows to a Parquet table."""
    return (
        rows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )


def windowed_counts(rows: DataFrame, time_col: str, lateness: str, width: str, slide: str | None, *axes: str) -> DataFrame:
    """Mentions and mean score per time window, tumbling or sliding; needs a ``score`` column."""
    span = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    return rows.withWatermark(time_col, lateness).groupBy(span, *axes).agg(
        F.count(F.lit(1)).alias("mentions"), F.round(F.avg("score"), 6).alias("mean_score")
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *axes,
             "mentions", "mean_score")


def newest_per_feed(rows: DataFrame, feed: str, time_col: str) -> DataFrame:
    """Row count and newest event time per feed; state is one row per feed."""
    return rows.groupBy(F.col(feed).alias("feed")).agg(
        F.count(F.lit(1)).alias("row_count"), F.max(time_col).alias("latest_data_at"))


def freshness_stream(rows: DataFrame, folder: str, feed: str, time_col: str) -> StreamingQuery:
    """Update-mode freshness; each micro-batch writes the feeds it changed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/{BATCH}={batch_id}")

    return _start(newest_per_feed(rows, feed, time_col), folder, "update", write)
