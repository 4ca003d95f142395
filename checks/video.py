"""Video ingestion: documents are videos, their source the channel, labels what is stored already.

Conversations are the transcripts: a role is a language, a turn a segment.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, table
from orelode.operators import video
from orelode.plans import jobs

KEYWORDS = [
    ("the", ["ENG", "ANGLO"]), ("und", ["GER"]), ("der", ["ger "]), ("que", ["FRA", "SPA"]), ("los", ["SPA"]),
    ("en", ["FRA", "SPA"]), ("thwh", ["RARE"]), ("qu", ["LATIN"]), ("ch", ["CENTRAL"]), ("sch", ["GER"]),
]
DEFAULT = ["NONE"]


def videos(spark, sf):
    video_id = F.concat(F.lit("v"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select(
        F.col("source").alias("channel_id"), F.col("doc_id").alias("position"), video_id.alias("video_id"),
        F.col("text").alias("title"), F.lit(None).cast("string").alias("published_at"), F.col("lang").alias("channel_title"),
        F.concat(F.lit("https://www.youtube.com/watch?v="), video_id).alias("video_url"))


def existing(spark, sf):
    return table(spark, sf, "labels").select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("video_id"))


def spoken(spark, sf):
    return table(spark, sf, "conversations").select(
        F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("video_id"),
        F.when(F.col("role") == "assistant", F.lit("en")).otherwise(F.col("role")).alias("language"),
        F.col("turn").alias("pos"), "text")


def listed(spark, sf):
    return spoken(spark, sf).groupBy("video_id", "language").agg(F.min("pos").alias("list_pos")).withColumn(
        "is_generated", F.col("language") != "en")


QUEUED = """queued AS (
  SELECT source AS channel_id, doc_id, 'v' || doc_id AS video_id, text AS title, lang AS channel_title,
    'https://www.youtube.com/watch?v=v' || doc_id AS video_url
  FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10)"""
SPOKEN = """spoken AS (
  SELECT 'v' || conv_id AS video_id, CASE WHEN role = 'assistant' THEN 'en' ELSE role END AS language, turn AS pos, text
  FROM conversations)"""
PICKED = """listed AS (SELECT video_id, language, min(pos) AS list_pos FROM spoken GROUP BY ALL),
picked AS (SELECT * FROM listed QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY language = 'en' DESC, list_pos) = 1)"""
DONE = f"""{QUEUED}, {SPOKEN}, {PICKED},
texts AS (
  SELECT p.video_id, p.language, string_agg(trim(s.text, ' '), chr(10) ORDER BY s.pos) FILTER (WHERE trim(s.text, ' ') <> '') AS t
  FROM picked p JOIN spoken s USING (video_id, language) GROUP BY ALL),
done AS (
  SELECT q.*, t.language, coalesce(t.t, '') AS t,
    CASE WHEN q.doc_id IN (SELECT doc_id FROM labels) THEN 'skipped' WHEN t.video_id IS NOT NULL THEN 'success'
         ELSE 'metadata_only' END AS outcome
  FROM queued q LEFT JOIN texts t USING (video_id))"""


def done(spark, sf):
    return jobs.video_ingest(videos(spark, sf), existing(spark, sf), listed(spark, sf), spoken(spark, sf))


@query("top_n_per_channel", f"WITH {QUEUED} SELECT channel_id, video_id FROM queued")
def top_n_per_channel(spark, sf):
    return video.newest_videos(videos(spark, sf), 10).select("channel_id", "video_id")


@query("ingest_once", "SELECT 'v' || doc_id AS video_id, source AS channel_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ingest_once(spark, sf):
    return video.not_ingested(videos(spark, sf), existing(spark, sf)).select("video_id", "channel_id")


@query("select_channels", "SELECT source AS name, count(*) AS videos FROM documents WHERE lower(trim(source)) IN "
                          "(SELECT lower(min(source)) FROM documents UNION ALL SELECT lower(max(source)) FROM documents) GROUP BY source")
def select_channels(spark, sf):
    channels = table(spark, sf, "documents").groupBy(F.col("source").alias("name")).agg(
        F.count(F.lit(1)).alias("videos")).withColumn("query", F.lit(None).cast("string"))
    ends = table(spark, sf, "documents").agg(F.min("source").alias("a"), F.max("source").alias("z")).first()
    return video.select_channels(channels, [f" {ends['a'].upper()} ", ends["z"]]).select("name", "videos")


@query("pick_transcript", f"WITH {SPOKEN}, {PICKED} SELECT video_id, language, list_pos FROM picked")
def pick_transcript(spark, sf):
    return video.pick_transcript(listed(spark, sf)).select("video_id", "language", "list_pos")


@query("assemble_transcript", """SELECT 'v' || conv_id AS video_id,
  string_agg(trim(text, ' '), chr(10) ORDER BY turn) FILTER (WHERE trim(text, ' ') <> '') AS transcript_text
FROM conversations GROUP BY conv_id""")
def assemble_transcript(spark, sf):
    # a short span, so that the joining of parts is compared as well
    return video.assemble_transcript(spoken(spark, sf).select("video_id", "pos", "text"), span=3)


@query("transcript_rows", f"""WITH {DONE} SELECT video_id, title, channel_id, channel_title, CAST(NULL AS VARCHAR) AS published_at,
  video_url, t AS transcript_text, language AS transcript_language, language <> 'en' AS is_generated
FROM done WHERE outcome = 'success'""")
def transcript_rows(spark, sf):
    return video.transcript_rows(done(spark, sf))


def tags_sql(title: str, channel: str) -> str:
    hay = f"lower({title} || ' ' || {channel})"
    found = " || ".join(
        f"CASE WHEN contains({hay}, '{w}') THEN {[s.strip().upper() for s in symbols]} ELSE CAST([] AS VARCHAR[]) END"
        for w, symbols in KEYWORDS)
    tags = f"({found})"
    unique = f"list_filter({tags}, lambda x, i: list_position({tags}, x) = i)"
    return f"array_to_string(CASE WHEN len({tags}) = 0 THEN ['NONE'] ELSE {unique}[1:8] END, ',')"


@query("symbol_tags", f"SELECT 'v' || doc_id AS video_id, {tags_sql('text', 'lang')} AS tags FROM documents")
def symbol_tags(spark, sf):
    tagged = video.with_symbol_tags(videos(spark, sf), KEYWORDS, DEFAULT)
    return tagged.select("video_id", F.array_join("symbol_tags", ",").alias("tags"))


_PAIRS = ", ".join(f"('{w}', '{s}')" for w, symbols in KEYWORDS for s in symbols)


@query("tag_theta_join", f"""SELECT 'v' || doc_id AS video_id, keyword, symbol FROM documents
JOIN (VALUES {_PAIRS}) k(keyword, symbol) ON contains(lower(text || ' ' || lang), keyword)""")
def tag_theta_join(spark, sf):
    return video.keyword_hits(videos(spark, sf), KEYWORDS)


@query("metadata_rows", f"""WITH {DONE} SELECT video_id, title, channel_title AS channel, '' AS published_at, video_url AS url,
  {tags_sql('title', 'channel_title')} AS tags,
  'Transcript unavailable from GitHub runner. Stored video metadata only. Reason: ' || substr(title, 1, 500) AS segment_text
FROM done WHERE outcome = 'metadata_only'""")
def metadata_rows(spark, sf):
    rows = video.metadata_rows(done(spark, sf), F.col("title"), KEYWORDS, DEFAULT)
    return rows.select("video_id", "title", "channel", "published_at", "url", F.array_join("symbol_tags", ",").alias("tags"),
                       F.col("segments")[0]["text"].alias("segment_text"))


# The market segments are further channels: without uploads, and one of them not to be found.
@query("ingest_totals", f"""WITH {DONE}, channels AS (
  SELECT source AS channel_id, true AS resolved FROM documents GROUP BY source
  UNION ALL SELECT c_mktsegment, c_mktsegment <> 'MACHINERY' FROM customer GROUP BY c_mktsegment)
SELECT count(*) FILTER (WHERE outcome = 'success') AS success,
  count(*) FILTER (WHERE outcome = 'metadata_only') AS metadata_only, count(*) FILTER (WHERE outcome = 'skipped') AS skipped,
  count(*) FILTER (WHERE outcome = 'failed') + (SELECT count(*) FROM channels WHERE NOT resolved) AS failed,
  (SELECT count(*) FROM channels WHERE resolved) AS channels, count(*) AS videos FROM done""")
def ingest_totals(spark, sf):
    channels = table(spark, sf, "documents").select(F.col("source").alias("channel_id"), F.lit(True).alias("resolved")).distinct().union(
        table(spark, sf, "customer").select("c_mktsegment", F.col("c_mktsegment") != "MACHINERY").distinct())
    return video.ingest_totals(done(spark, sf), channels)
