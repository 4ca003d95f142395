"""Channel videos and transcripts: newest per channel, once-only, assembly, tags, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode import dims
from orelode.functions import text
from orelode.operators.ranking import latest_per, top_n_per

# positions of one transcript that are assembled together
PART_SPAN = 4096
_BLANKS = " \t\n\r\f\v\u00a0"


def select_channels(channels: DataFrame, wanted: list[str]) -> DataFrame:
    """Channels whose name or query is wanted; all where nothing is named."""
    names = [w.strip().lower() for w in wanted if w.strip()]
    if not names:
        return channels
    return channels.filter(
        F.lower(F.trim("name")).isin(names) | F.coalesce(F.lower(F.trim("query")).isin(names), F.lit(False)))


def newest_videos(videos: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` playlist entries per channel; playlists run newest first."""
    return top_n_per(videos, ["channel_id"], [F.col("position"), F.col("video_id")], n)


def not_ingested(videos: DataFrame, existing: DataFrame) -> DataFrame:
    return videos.join(existing.select("video_id"), "video_id", "left_anti")


def pick_transcript(listed: DataFrame) -> DataFrame:
    """One listed transcript per video: English before others, then list order."""
    english = F.coalesce(F.col("language") == "en", F.lit(False))
    return latest_per(listed, ["video_id"], [english.desc(), F.col("list_pos")])


def transcript_parts(segments: DataFrame, span: int = PART_SPAN) -> DataFrame:
    """Transcript text in parts of at most ``span`` positions; no part outgrows a task."""
    said = segments.select("video_id", "pos", F.btrim("text", F.lit(_BLANKS)).alias("said")).filter(F.col("said") != "")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "said")))
    return said.groupBy("video_id", F.floor(F.col("pos") / span).cast("long").alias("part")).agg(
        F.array_join(F.transform(ordered, lambda s: s["said"]), "\n").alias("part_text"))


def assemble_transcript(segments: DataFrame, span: int = PART_SPAN) -> DataFrame:
    """Transcript text per video: its parts joined in order.

    The segments of a long video are sorted in several tasks; only finished parts
    meet in the last one. Use ``transcript_parts`` where one video's text would
    not fit in a row.
    """
    ordered = F.array_sort(F.collect_list(F.struct("part", "part_text")))
    return transcript_parts(segments, span).groupBy("video_id").agg(
        F.array_join(F.transform(ordered, lambda p: p["part_text"]), "\n").alias("transcript_text"))


def _tag_text():
    return F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("channel_title", F.lit(""))))


def with_symbol_tags(videos: DataFrame, keywords=None, default=None, whole_word: bool = False) -> DataFrame:
    return videos.withColumn("symbol_tags", text.symbol_tags(_tag_text(), keywords, default, whole_word=whole_word))


def keyword_hits(videos: DataFrame, keywords=None) -> DataFrame:
    """One row per video and keyword found in its title or channel.

    The word list is short and fixed, so it is tried inside each row; no join.
    """
    table = F.array(*[
        F.struct(F.lit(word).alias("keyword"), F.array(*[F.lit(s) for s in symbols]).alias("symbols"))
        for word, symbols in (keywords or dims.KEYWORD_TAGS)
    ])
    hits = text.once(_tag_text(), lambda s: F.filter(table, lambda k: F.contains(s, k["keyword"])))
    return videos.select("video_id", F.inline(hits)).select("video_id", "keyword", F.explode("symbols").alias("symbol"))


def outcomes(videos: DataFrame, existing: DataFrame, transcripts: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """Every queued video with its outcome: skipped, success, metadata_only or failed.

    ``refused`` lists videos for which the metadata record could not be stored either.
    """
    known = existing.select("video_id").distinct().withColumn("known", F.lit(True))
    joined = videos.join(known, "video_id", "left").join(transcripts, "video_id", "left")
    lost = F.lit(False)
    if refused is not None:
        joined = joined.join(refused.select("video_id").distinct().withColumn("refused", F.lit(True)), "video_id", "left")
        lost = F.col("refused").isNotNull()
    return joined.withColumn(
        "outcome",
        F.when(F.col("known").isNotNull(), F.lit("skipped"))
        .when(F.col("transcript_text").isNotNull(), F.lit("success"))
        .when(lost, F.lit("failed"))
        .otherwise(F.lit("metadata_only")),
    ).drop("known", "refused")


def ingest_totals(done: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """One row of counts. ``channels`` (``channel_id, resolved``) lists all that were asked for.

    With it a resolved channel without uploads counts as a channel, and one that could not
    be resolved as failed; without it only channels with a video are known.
    """
    def having(outcome: str):
        return F.count_if(F.col("outcome") == outcome)

    totals = done.agg(
        having("success").alias("success"), having("metadata_only").alias("metadata_only"),
        having("skipped").alias("skipped"), having("failed").alias("failed"),
        F.countDistinct("channel_id").alias("channels"), F.count(F.lit(1)).alias("videos"))
    if channels is None:
        return totals
    resolved = channels.agg(F.count_if("resolved")).scalar()
    lost = channels.agg(F.count_if(~F.coalesce("resolved", F.lit(False)))).scalar()
    return totals.withColumns({"failed": F.col("failed") + lost, "channels": resolved})


def transcript_rows(done: DataFrame) -> DataFrame:
    """Records of videos with a transcript."""
    return done.filter(F.col("outcome") == "success").select(
        "video_id", "title", "channel_id", "channel_title", "published_at", "video_url", "transcript_text",
        F.col("language").alias("transcript_language"),
        F.coalesce(F.col("is_generated"), F.lit(False)).alias("is_generated"))


def metadata_rows(done: DataFrame, reason, keywords=None, default=None) -> DataFrame:
    """Records of videos without one: symbol tags and a placeholder segment."""
    note = F.concat(
        F.lit("Transcript unavailable from GitHub runner. Stored video metadata only. Reason: "),
        F.substring(reason, 1, 500))
    return with_symbol_tags(done.filter(F.col("outcome") == "metadata_only"), keywords, default).select(
        "video_id", "title",
        F.coalesce("channel_title", F.lit("")).alias("channel"),
        F.coalesce(F.col("published_at").cast("string"), F.lit("")).alias("published_at"),
        F.col("video_url").alias("url"),
        "symbol_tags",
        F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("duration"), note.alias("text"))).alias("segments"))
