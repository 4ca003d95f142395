"""The whole portfolio job on ``pages``.

A customer is a company and page n the homepage of customer n; the known project
pages of a company are the pages of its host. Debtors without a page have a
homepage that is not in the snapshot, so they fail.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from checks import sqltext as S
from checks import web as cw
from checks.registry import plain, query, table
from orelode.functions import html as H
from orelode.functions import urls as U
from orelode.operators import web
from orelode.operators.health import count_by
from orelode.plans.portfolio import page_snapshot, project_portfolio

AT = "2024-01-31T00:00:00Z"


def inputs(spark, sf):
    customer = table(spark, sf, "customer")
    pages = cw.pages(spark, sf).select("page_id", "url", "html")
    symbol = F.upper("c_name").alias("symbol")
    companies = customer.select(
        symbol, F.concat("c_name", F.lit(" Limited")).alias("company_name"), F.col("c_name").alias("short_name"),
        F.lit("gold").alias("metal"), F.lower("c_mktsegment").alias("company_type"))
    light = table(spark, sf, "pages").select(F.col("page_id").alias("c_custkey"), "url")
    curated = customer.join(light, "c_custkey").select(symbol, "url")
    discovered = customer.filter(F.col("c_acctbal") < 0).select(
        symbol, F.concat(F.lit("https://nowhere.example/"), F.col("c_custkey").cast("string")).alias("url"))
    origin = F.regexp_extract(U.normalize_url(F.col("url")), r"^([a-z]+://[^/?#]*)", 1)
    by_site = light.select(origin.alias("site"), F.col("c_custkey").alias("pos"),
                           F.regexp_replace(U.normalize_url(F.col("url")), r"^[a-z]+://[^/?#]*", "").alias("path"))
    known = web.SitePaths(curated.select("symbol", origin.alias("site")), by_site)
    landing = customer.filter(F.col("c_mktsegment") == "BUILDING").select(
        symbol, F.lit(0).alias("pos"), F.lit("/our-business/").alias("path"))
    return companies, curated, discovered, pages.drop("page_id"), known, landing


def portfolio(spark, sf, columns=None):
    companies, curated, discovered, pages, known, landing = inputs(spark, sf)
    return project_portfolio(companies, curated, discovered, pages, known, landing, AT, vocabulary=cw.WORDS, columns=columns)


OTHERS = ", ".join(f"coalesce(f.{c}, '') AS {c}" for c in (
    "ownership", "location", "status", "mining_style", "measured_indicated_mineral_resources", "inferred_mineral_resources",
    "geology_text"))

ROWS = f"""{cw.CARDS}, {cw.INFERRED},
named_cards AS (SELECT page_id, text, {cw.name_sql(S.lines('text'))} AS name FROM flagged WHERE likely),
good AS (SELECT * FROM named_cards WHERE name <> ''),
blocks AS (
  SELECT page_id, name, text AS evidence, 'semantic_html' AS layer FROM good
  UNION ALL
  SELECT page_id, name, array_to_string(lines, chr(10)), 'page_context' FROM inferred
  WHERE page_id NOT IN (SELECT page_id FROM good) AND length(array_to_string(lines, chr(10))) > 250
    AND {S.count_terms("lower(array_to_string(lines, chr(10)))", cw.TERMS)} > 0 AND name <> ''),
lined AS (SELECT *, {S.lines('evidence')} AS lines FROM blocks),
described AS (
  SELECT *, array_to_string(list_filter(lines, lambda x: length(x) > 45)[1:8], ' ') AS d,
    {cw.first_sql(cw.OWNERSHIP)} AS own, {cw.first_sql(cw.LOCATION)} AS loc, {cw.first_sql(cw.STATUS)} AS sta,
    {cw.first_sql(cw.STYLE)} AS sty, regexp_extract_all(evidence, '{cw.RESOURCE}') AS hits,
    string_split(regexp_replace({S.squeeze('evidence')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS sentences,
    regexp_extract_all(evidence, '{cw.REPORT}') AS reports,
    list_filter(regexp_extract_all(evidence, 'https?://[^\\s"'')<>]+'), lambda u: regexp_matches(u, '{cw.REPORT_URL}')) AS report_urls
  FROM lined),
picked AS (
  SELECT *, array_to_string(list_filter(hits, lambda h: contains(lower(h), 'measured') OR contains(lower(h), 'indicated')
      OR contains(lower(h), 'm&i'))[1:3], ' ') AS mea,
    array_to_string(list_filter(hits, lambda h: contains(lower(h), 'inferred'))[1:3], ' ') AS inf,
    array_to_string(list_filter(sentences, lambda x: regexp_matches(x, '{cw.GEOLOGY}'))[1:5], ' ') AS geo FROM described),
fields AS (
  SELECT page_id, {cw.cleaned_name_sql('name')} AS project_name, layer, {S.trim_text('d', 1800)} AS description_text,
    {S.trim_text('evidence', 2400)} AS evidence_text, {S.trim_text('own', 500)} AS ownership,
    {S.trim_text('loc', 500)} AS location, {S.trim_text('sta', 500)} AS status, {S.trim_text('sty', 500)} AS mining_style,
    {S.trim_text('mea', 500)} AS measured_indicated_mineral_resources,
    {S.trim_text('inf', 500)} AS inferred_mineral_resources, {S.trim_text('geo', 900)} AS geology_text,
    to_json({cw.unique_sql('reports')})::VARCHAR AS technical_report_names_json,
    to_json({cw.unique_sql('report_urls')})::VARCHAR AS technical_report_urls_json,
    round(least(0.98::DOUBLE, 0.42::DOUBLE + 0.18::DOUBLE + CASE WHEN d <> '' THEN 0.12::DOUBLE ELSE 0 END
      + CASE WHEN regexp_matches(evidence, '{cw.LOCATION}') THEN 0.08::DOUBLE ELSE 0 END
      + CASE WHEN regexp_matches(evidence, '{cw.STATUS}') THEN 0.06::DOUBLE ELSE 0 END
      + CASE WHEN regexp_matches(evidence, '{cw.EVIDENCE}') THEN 0.08::DOUBLE ELSE 0 END
      + CASE WHEN layer = 'semantic_html' THEN 0.06::DOUBLE ELSE 0 END), 3) AS confidence FROM picked),
origins AS (SELECT page_id, {S.normal_url('url')} AS url, {S.ORIGIN.format('url')} AS origin FROM pages),
candidates AS (
  SELECT upper(c_name) AS symbol, o.page_id, o.url,
    row_number() OVER (PARTITION BY c_custkey ORDER BY o.page_id) AS candidate_rank
  FROM customer JOIN origins h ON h.page_id = c_custkey JOIN origins o USING (origin) QUALIFY candidate_rank <= 55),
best AS (
  SELECT c.symbol, c.url, f.*, p.title FROM candidates c JOIN fields f USING (page_id) JOIN parts p USING (page_id)
  QUALIFY row_number() OVER (PARTITION BY symbol, lower(project_name)
    ORDER BY confidence + length(description_text) / 10000.0::DOUBLE DESC, candidate_rank) = 1),
found AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY project_name, url) <= 40),
rows AS (
  SELECT upper(c_name) AS symbol, c_name || ' Limited' AS company_name, c_name AS short_name, 'gold' AS metal,
    lower(c_mktsegment) AS company_type, coalesce(f.project_name, '') AS project_name,
    '2024-01-31T00:00:00Z' AS retrieved_at, {OTHERS},
    coalesce(f.technical_report_names_json, '[]') AS technical_report_names_json,
    coalesce(f.technical_report_urls_json, '[]') AS technical_report_urls_json,
    coalesce(f.url, h.url, CASE WHEN c_acctbal < 0 THEN 'https://nowhere.example/' || c_custkey END, '') AS source_url,
    coalesce(f.title, '') AS page_title, coalesce(f.description_text, '') AS description_text,
    coalesce(f.evidence_text, '') AS evidence_text, coalesce(f.confidence, 0.0::DOUBLE) AS confidence,
    coalesce(f.layer, 'status') AS extraction_layer,
    CASE WHEN f.symbol IS NOT NULL THEN 'found' WHEN h.page_id IS NULL AND c_acctbal < 0 THEN 'failed'
         ELSE 'not_found' END AS status_code,
    CASE WHEN f.symbol IS NOT NULL THEN '' WHEN h.page_id IS NOT NULL THEN 'No portfolio project pages found'
         WHEN c_acctbal < 0 THEN 'homepage is not in the page snapshot' ELSE 'No homepage URL available' END AS error_message
  FROM customer LEFT JOIN pages h ON h.page_id = c_custkey LEFT JOIN found f ON f.symbol = upper(c_name))"""


@query("project_portfolio", f"WITH {ROWS} SELECT *, source_url AS project_url FROM rows")
def project_portfolio_rows(spark, sf):
    return plain(portfolio(spark, sf))


@query("project_status_snapshot", f"""WITH {ROWS} SELECT symbol, min(status_code) AS status,
  count(*) FILTER (WHERE status_code = 'found') AS projects FROM rows GROUP BY symbol""")
def project_status_snapshot(spark, sf):
    companies, curated, discovered, pages, known, landing = inputs(spark, sf)
    name = "pages_" + re.sub(r"\W", "_", sf)  # a table for each set of inputs
    held = page_snapshot(pages, name, spark.sparkContext.defaultParallelism)
    return web.project_status(project_portfolio(
        companies, curated, discovered, held, known, landing, AT, vocabulary=cw.WORDS, snapshot=True,
        columns=["symbol", "status_code"]))


@query("project_status", f"""WITH {ROWS} SELECT symbol, min(status_code) AS status,
  count(*) FILTER (WHERE status_code = 'found') AS projects FROM rows GROUP BY symbol""")
def project_status(spark, sf):
    return web.project_status(portfolio(spark, sf, ["symbol", "status_code"]))


@query("projects_by_group", f"WITH {ROWS} SELECT status_code, extraction_layer, count(*) AS n FROM rows GROUP BY ALL")
def projects_by_group(spark, sf):
    return count_by(portfolio(spark, sf, ["status_code", "extraction_layer"]), "status_code", "extraction_layer")


@query("status_fallback", """WITH found AS (
  SELECT DISTINCT c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT')
SELECT upper(c.c_name) AS symbol, CASE WHEN f.c_name IS NULL THEN 'not_found' ELSE 'found' END AS status_code,
  CASE WHEN f.c_name IS NULL THEN 'status' ELSE 'semantic_html' END AS extraction_layer,
  CASE WHEN f.c_name IS NULL THEN 'No homepage URL available' ELSE '' END AS error_message
FROM customer c LEFT JOIN found f USING (c_name)""")
def status_fallback(spark, sf):
    companies = inputs(spark, sf)[0].select(
        "*", F.lit(None).cast("string").alias("homepage_url"), F.lit("not_found").alias("status_code"),
        F.lit("No homepage URL available").alias("error_message"))
    urgent = table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_custkey").alias("c_custkey")).distinct()
    given = {"confidence": F.lit(0.6), "status_code": F.lit("found"), "extraction_layer": F.lit("semantic_html"),
             "retrieved_at": F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")}
    found = table(spark, sf, "customer").join(urgent, "c_custkey", "left_semi").select(
        F.upper("c_name").alias("symbol"),
        *[given.get(c, F.lit("")).alias(c) for c in web.PROJECT_COLUMNS if c != "symbol"])
    return web.with_status_rows(companies, found, AT).select("symbol", "status_code", "extraction_layer", "error_message")


# A channel page is made of each page by putting an identifier in its place.
@query("channel_id", """SELECT page_id, CASE WHEN contains(html, CASE WHEN starts_with(url, 'https') THEN '<footer>' ELSE '<title>' END)
  THEN 'UC' || substr(sha1(url), 1, 22) END AS channel_id FROM pages""")
def channel_id(spark, sf):
    name = F.concat(F.lit("UC"), F.substring(F.sha1("url"), 1, 22))
    external = F.concat(F.lit('<footer>"externalId":"'), name, F.lit('"'))
    linked = F.concat(F.lit("<title>https://www.youtube.com/channel/"), name, F.lit("/about "))
    html = F.when(F.col("url").startswith("https"), F.replace("html", F.lit("<footer>"), external)).otherwise(
        F.replace("html", F.lit("<title>"), linked))
    return cw.pages(spark, sf).select("page_id", H.channel_id(html).alias("channel_id"))
