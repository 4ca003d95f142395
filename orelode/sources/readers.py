"""Readers with fixed schemas; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.functions.keys import filled
from orelode.functions.times import parse_time
from orelode.functions.urls import normalize_url
from orelode.operators.coverage import found_homepages

_COMPANY = (
    "symbol string, name string, companyName string, metal string, metalFocus string, "
    "companyType string, type string, queries array<string>, cik string"
)
_HOMEPAGE = "symbol string, homepage_url string, status string"
_RUN = (
    "id bigint, name string, status string, conclusion string, run_started_at string, created_at string, "
    "updated_at string, html_url string, head_sha string, display_title string, head_branch string"
)
_ITEM = (
    "snippet struct<title:string, publishedAt:string, channelTitle:string, resourceId:struct<videoId:string>, "
    "playlistId:string, channelId:string>"
)


def _as_struct(ddl: str) -> str:
    return "struct<" + ", ".join(part.strip().replace(" ", ":", 1) for part in ddl.split(", ")) + ">"


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Company universe, one JSON document: a map by symbol or an ``items`` list.

    Symbols are upper-cased; of several entries of a symbol the last wins.
    """
    doc = spark.read.text(path, wholetext=True)
    entry = _as_struct(_COMPANY)
    doc = doc.select(
        F.from_json("value", f"items array<{entry}>")["items"].alias("items"),
        F.from_json("value", f"map<string,{entry}>").alias("by_symbol"))
    # the map form also parses an items document, as one empty entry named "items"
    listed = F.transform("items", lambda e: F.struct(e["symbol"].alias("key"), e.alias("value")))
    rows = doc.select(F.posexplode(F.coalesce(listed, F.map_entries("by_symbol"))).alias("pos", "e")).filter(
        F.nullif(F.col("e.key"), F.lit("")).isNotNull())
    e = F.col("e.value")
    symbol = F.upper("e.key")
    return rows.groupBy(symbol.alias("symbol")).agg(
        F.max_by(F.struct(
            filled(e["name"], e["companyName"], symbol).alias("name"),
            filled(e["metal"], e["metalFocus"], F.lit("unknown")).alias("metal"),
            filled(e["companyType"], e["type"]).alias("company_type"),
            e["queries"].alias("queries"),
            F.nullif(e["cik"], F.lit("")).alias("cik"),
        ), "pos").alias("v")).select("symbol", "v.*")


def read_companies(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Company dimension; names fall back from company to name to symbol.

    ``ordinal`` sorts the rows as the files have them, for a limit in the order of the dimension.
    """
    schema = "symbol string, company string, name string, metal string, type string, aliases array<string>, q string"
    return spark.read.schema(schema).format(fmt).load(path).select(
        "symbol",
        filled(F.col("company"), F.col("name"), F.col("symbol")).alias("company_name"),
        filled(F.col("name"), F.col("symbol")).alias("short_name"),
        F.coalesce("metal", F.lit("")).alias("metal"),
        F.coalesce("type", F.lit("")).alias("company_type"),
        "aliases", "q",
        F.struct("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("ordinal"))


def read_homepages(spark: SparkSession, path: str) -> DataFrame:
    """Found homepages (symbol, url) from a list or a ``profiles`` envelope; the last row of a symbol wins."""
    schema = f"{_HOMEPAGE}, profiles array<{_as_struct(_HOMEPAGE)}>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    own = F.array(F.struct("symbol", "homepage_url", "status"))
    rows = doc.withColumn("line", F.monotonically_increasing_id()).select(
        "line", F.posexplode(F.coalesce("profiles", own)).alias("pos", "row"))
    placed = rows.select("row.*", F.struct("line", "pos").alias("arrival"))
    return found_homepages(placed, "arrival")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run history: one JSON document per workflow, flattened; the workflow is the file's name."""
    doc = spark.read.schema(f"workflow_file string, workflow_runs array<{_as_struct(_RUN)}>").json(path, multiLine=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    runs = doc.select(filled(F.col("workflow_file"), stem).alias("workflow_file"), F.explode("workflow_runs").alias("r"))
    times = ("run_started_at", "created_at", "updated_at")
    return runs.select("workflow_file", "r.*").select(
        "workflow_file", "id", "name", "status", "conclusion",
        *[parse_time(F.col(c)).alias(c) for c in times],
        "html_url", "head_sha", "display_title", F.col("head_branch").alias("branch"))


def read_table_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Query outputs per table: ``{table}.json`` is the payload, ``{table}.err`` the error text."""
    files = spark.read.text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    kind = F.regexp_extract("file", r"\.(json|err)$", 1)
    return files.filter(kind != "").groupBy(F.regexp_replace("file", r"\.(json|err)$", "").alias("table")).agg(
        F.max(F.when(kind == "json", F.col("value"))).alias("payload"),
        F.max(F.when(kind == "err", F.col("value"))).alias("error"))


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Page snapshots by normalised URL; bytes that are not UTF-8 are replaced."""
    raw = spark.read.format(fmt).load(path)
    html = F.col("html")
    if dict(raw.dtypes)["html"] == "binary":
        html = F.make_valid_utf8(html.cast("string"))
    return raw.select(normalize_url(F.col("url")).alias("url"), html.alias("html"))


def flatten_videos(pages: DataFrame) -> DataFrame:
    """Playlist pages (``channel_id``, ``page``, ``items``) to one row per video."""
    each = pages.select("channel_id", "page", F.posexplode("items").alias("pos", "item"))
    s = F.col("item.snippet")
    video_id = s["resourceId"]["videoId"]
    return each.filter(F.nullif(video_id, F.lit("")).isNotNull()).select(
        "channel_id",
        F.struct(F.col("page").cast("long").alias("page"), F.col("pos").cast("long").alias("pos")).alias("position"),
        video_id.alias("video_id"),
        F.coalesce(s["title"], F.lit("")).alias("title"),
        s["publishedAt"].alias("published_at"),
        F.coalesce(s["channelTitle"], F.lit("")).alias("channel_title"),
        F.concat(F.lit("https://www.youtube.com/watch?v="), video_id).alias("video_url"))


def read_videos(spark: SparkSession, path: str) -> DataFrame:
    """Playlist item pages, one JSON document each, with their ``channel_id`` and ``page`` number."""
    schema = f"channel_id string, page int, items array<struct<{_ITEM.replace(' ', ':', 1)}>>"
    return flatten_videos(spark.read.schema(schema).json(path))


def read_segments(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Transcripts with a segment list, to one row per segment."""
    schema = (
        "video_id string, language string, is_generated boolean, "
        "segments array<struct<start:double,duration:double,text:string>>"
    )
    raw = spark.read.schema(schema).format(fmt).load(path)
    return raw.select("video_id", "language", "is_generated", F.posexplode("segments").alias("pos", "s")).select(
        "video_id", "language", "is_generated", "pos", "s.start", "s.duration", "s.text")
