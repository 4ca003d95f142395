"""Files written from the shared tables and read back by the readers.

Each format is written to a folder of its own and compared with the tables it was written from.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqltext as S
from checks.registry import plain, query, table
from orelode.functions.times import iso_text
from orelode.operators.coverage import select_symbols
from orelode.operators.ranking import first_rows
from orelode.session import work_folder
from orelode.sources import readers, writers


def documents(df, spark, name):
    """Each row as a JSON document in a file of its own."""
    folder = work_folder(spark, name)
    df.write.option("maxRecordsPerFile", 1).json(folder)
    return folder


def one_document(df, spark, name, column):
    """All rows as the one JSON document the format is."""
    folder = work_folder(spark, name)
    df.agg(F.collect_list(F.struct(*df.columns)).alias(column)).select(F.to_json(F.struct(column)).alias("value")).write.text(folder)
    return folder


def companies(spark, sf):
    folder = work_folder(spark, "companies")
    rows = table(spark, sf, "customer").orderBy("c_custkey").select(
        F.upper("c_name").alias("symbol"), F.concat("c_name", F.lit(" Limited")).alias("company"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).alias("name"),
        F.lit("gold").alias("metal"), F.lower("c_mktsegment").alias("type"))
    writers.write_json(rows, folder, sorted_keys=True)
    return readers.read_companies(spark, folder)


COMPANIES = """SELECT upper(c_name) AS symbol, c_name || ' Limited' AS company_name,
  CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name ELSE upper(c_name) END AS short_name, 'gold' AS metal,
  lower(c_mktsegment) AS company_type FROM customer"""


@query("companies_in_order", f"{COMPANIES} ORDER BY c_custkey LIMIT 25")
def companies_in_order(spark, sf):
    return first_rows(companies(spark, sf), [F.col("ordinal")], 25).drop("aliases", "q", "ordinal")


@query("select_symbols", f"SELECT * FROM ({COMPANIES}) WHERE symbol LIKE '%7'")
def chosen_symbols(spark, sf):
    wanted = table(spark, sf, "customer").where("c_name like '%7'").select(
        F.concat(F.lit(" "), F.lower("c_name"), F.lit(" ")).alias("symbol"))
    return select_symbols(companies(spark, sf), wanted).drop("aliases", "q", "ordinal")


@query("read_universe", """SELECT upper(c_name) AS symbol, c_name AS name, coalesce(nullif(lower(c_mktsegment), 'building'), 'unknown') AS metal,
  'producer' AS company_type FROM customer""")
def read_universe(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.lower("c_name").alias("symbol"), F.col("c_name").alias("companyName"),
        F.nullif(F.lower("c_mktsegment"), F.lit("building")).alias("metalFocus"), F.lit("producer").alias("type"))
    found = readers.read_universe(spark, one_document(rows, spark, "universe", "items"))
    return found.select("symbol", "name", "metal", "company_type")


@query("read_homepages", """SELECT upper(c_name) AS symbol, url FROM customer JOIN pages ON page_id = c_custkey WHERE c_acctbal >= 0""")
def read_homepages(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("c_custkey"), F.col("url").alias("homepage_url"))
    rows = table(spark, sf, "customer").join(pages, "c_custkey").select(
        F.lower("c_name").alias("symbol"), "homepage_url",
        F.when(F.col("c_acctbal") >= 0, "found").otherwise("not_found").alias("status"))
    return readers.read_homepages(spark, one_document(rows, spark, "homepages", "profiles"))


@query("read_runs", """SELECT event_type || '.yml' AS workflow_file, event_id AS id, 'completed' AS status,
  CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS conclusion,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at, 'main' AS branch FROM events WHERE user_id % 10 = 3""")
def read_runs(spark, sf):
    run = F.struct(
        F.col("event_id").alias("id"), F.lit("completed").alias("status"),
        F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("conclusion"),
        iso_text(F.col("ts")).alias("created_at"), F.lit("main").alias("head_branch"))
    rows = table(spark, sf, "events").where("user_id % 10 = 3").groupBy(
        F.concat("event_type", F.lit(".yml")).alias("workflow_file")).agg(F.collect_list(run).alias("workflow_runs"))
    found = readers.read_runs(spark, documents(rows, spark, "runs"))
    return plain(found.select("workflow_file", "id", "status", "conclusion", "created_at", "branch"))


@query("read_pages", f"SELECT {S.normal_url('url')} AS url, html FROM pages")
def read_pages(spark, sf):
    folder = work_folder(spark, "snapshot")
    writers.append_records(table(spark, sf, "pages").select("url", F.col("html").cast("binary").alias("html")), folder)
    return readers.read_pages(spark, folder)


@query("read_videos", """SELECT 'c' || o_custkey AS channel_id, 'v' || o_orderkey AS video_id, o_orderpriority AS title,
  'https://www.youtube.com/watch?v=v' || o_orderkey AS video_url FROM orders""")
def read_videos(spark, sf):
    item = F.struct(F.struct(
        F.col("o_orderpriority").alias("title"),
        F.struct(F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("videoId")).alias("resourceId")).alias("snippet"))
    rows = table(spark, sf, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("channel_id")).agg(
        F.collect_list(item).alias("items")).withColumn("page", F.lit(1))
    folder = work_folder(spark, "videos")
    writers.write_json(rows, folder)
    return readers.read_videos(spark, folder).select("channel_id", "video_id", "title", "video_url")


@query("read_segments", """SELECT 'c' || conv_id AS video_id, 'en' AS language, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos,
  CAST(turn AS DOUBLE) AS start, text FROM conversations""")
def read_segments(spark, sf):
    segment = F.struct(F.col("turn").cast("double").alias("start"), F.lit(1.0).alias("duration"), F.col("text").alias("text"))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(segment)).alias("segments")).select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("video_id"), F.lit("en").alias("language"), "segments")
    folder = work_folder(spark, "segments")
    writers.write_json(rows, folder)
    return readers.read_segments(spark, folder).select("video_id", "language", "pos", "start", "text")
