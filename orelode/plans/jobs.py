"""Feed and table health, homepage coverage and video ingestion as whole jobs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.operators import coverage, health, video


def feed_health(runs: DataFrame, workflows: DataFrame, as_of, branch: str = "main", n: int = 10) -> DataFrame:
    """A check per workflow: which feeds are fresh, stale, failed or empty."""
    heads = health.run_heads(health.on_branch(runs, branch), n)
    return health.classify_workflow(workflows, heads, as_of)


class Health(NamedTuple):
    """What a health job writes: rows of runs (none for tables), checks and alerts, and one row of counts."""

    runs: DataFrame | None
    checks: DataFrame
    alerts: DataFrame
    summary: DataFrame


def feed_health_job(runs: DataFrame, workflows: DataFrame, as_of, branch: str = "main", n: int = 10) -> Health:
    """The latest run of each workflow, its check, the alerts and the summary."""
    checks = feed_health(runs, workflows, as_of, branch, n)
    latest = health.project_runs(health.latest_run(health.on_branch(runs, branch)), workflows, branch)
    return Health(latest, checks, health.alerts_from_checks(checks, workflows), health.health_summary(checks))


def table_health_job(config: DataFrame, stats: DataFrame, as_of, strict: bool = False, store: str = "d1") -> Health:
    """The check of each configured table, an alert for each that is not at rest, and the summary."""
    checks = health.classify_table(config, stats, as_of, strict, store)
    named = config.select(F.col("table").alias("file"), F.col("label").alias("name"))
    return Health(None, checks, health.alerts_from_checks(checks, named, store), health.table_summary(checks))


def homepage_coverage(universe: DataFrame, curated: DataFrame, generated_at, requested: DataFrame | None = None,
                      limit: int | None = None) -> DataFrame:
    requests = coverage.requested_symbols(universe, requested, limit)
    return coverage.homepage_rows(requests, universe, curated, generated_at)


def video_ingest(videos: DataFrame, existing: DataFrame, listed: DataFrame, segments: DataFrame, n: int = 10) -> DataFrame:
    """Queued videos with their outcome and, where there is one, transcript.

    ``listed`` names the transcripts of a video (``video_id, language, list_pos,
    is_generated``), ``segments`` their text (``video_id, language, pos, text``).
    Only transcripts of videos still to do are assembled.
    """
    queued = video.newest_videos(videos, n)
    todo = video.not_ingested(queued, existing).select("video_id")
    picked = video.pick_transcript(listed.join(todo, "video_id", "left_semi"))
    spoken = segments.join(picked.select("video_id", "language"), ["video_id", "language"], "left_semi")
    texts = picked.select("video_id", "language", "is_generated").join(
        video.assemble_transcript(spoken), "video_id", "left"
    ).withColumn("transcript_text", F.coalesce("transcript_text", F.lit("")))
    return video.outcomes(queued, existing, texts)
