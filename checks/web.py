"""Page parts, link discovery, project blocks and fields on ``pages`` and ``documents``.

The pages hold invented prose, so the vocabulary is made of its commonest words.
For the field extraction, frequent words of the documents are exchanged for
mining phrases, so that every pattern meets whole texts with many hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sqltext as S
from checks.registry import plain, query, table, texts
from orelode.functions import html as H
from orelode.functions import text as T
from orelode.functions import urls as U
from orelode.operators import web

TERMS = ["the", "and", "to", "of", "en", "sch", "la"]
NEGATIVE = ["spam", "pills", ".html"]
ANCHORS = ["the", "and", "en", "la"]
BLOCKS = ["ad", "article"]
NOUNS = ["the", "der", "la", "que"]
WORDS = web.Vocabulary(TERMS, NEGATIVE, ANCHORS, BLOCKS, NOUNS)


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "pages")


@query("page_title_links", f"""WITH {S.PAGES}
SELECT page_id, title, array_to_string(lines, chr(10)) AS lines_text,
  (SELECT string_agg(href || ' ' || text, chr(10) ORDER BY link_pos) FROM links l WHERE l.page_id = p.page_id) AS links_text
FROM parts p""")
def page_title_links(spark, sf):
    parts = web.page_parts(pages(spark, sf))
    links = F.transform("links", lambda a: F.concat(a["href"], F.lit(" "), a["text"]))
    return parts.select("page_id", "title", F.array_join("lines", "\n").alias("lines_text"),
                        F.array_join(links, "\n").alias("links_text"))


LINKED = f"""{S.PAGES},
joined AS (SELECT *, {S.ORIGIN.format('base_url')} || href AS target FROM links),
normal AS (SELECT *, {S.normal_url('target')} AS url FROM joined),
scored AS (
  SELECT page_id, base_url, link_pos, url, text,
    CAST(2 * {S.count_terms("lower(text || ' ' || lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)))", TERMS)}
      + CASE WHEN {S.any_word('text', ANCHORS)} THEN 4 ELSE 0 END AS BIGINT) AS score
  FROM normal
  WHERE NOT (contains(lower(url), 'spam') OR contains(lower(url), 'pills') OR contains(lower(url), '.html'))
    AND NOT regexp_matches(lower(url), '\\.(jpg|jpeg|png|gif|webp|zip|docx?|xlsx?)($|\\?)'))"""


def page_links(spark, sf):
    parts = web.page_parts(pages(spark, sf))
    return web.scored_links(parts.select("page_id", F.col("url").alias("base_url"), "links"), WORDS)


@query("link_scores", f"WITH {LINKED} SELECT page_id, CAST(link_pos AS INT) AS link_pos, url, text AS link_text, score "
                      "FROM scored WHERE score > 0")
def link_scores(spark, sf):
    return page_links(spark, sf).select("page_id", "link_pos", "url", "link_text", "score")


@query("candidate_rank", f"""WITH {LINKED},
cand AS (
  SELECT {S.SITE.format('url')} AS symbol, {S.normal_url('url')} AS url, 0 AS source_rank, page_id AS place, 0 AS score,
    0 AS link_pos FROM pages
  UNION ALL SELECT {S.SITE.format('base_url')}, url, 2, page_id, score, link_pos FROM scored WHERE score > 0),
once AS (SELECT * FROM cand QUALIFY row_number() OVER (
  PARTITION BY symbol, url ORDER BY source_rank, place, score DESC, link_pos) = 1)
SELECT symbol, url, row_number() OVER (PARTITION BY symbol ORDER BY source_rank, place, score DESC, link_pos) AS candidate_rank
FROM once QUALIFY candidate_rank <= 55""")
def candidate_rank(spark, sf):
    own = pages(spark, sf).select(
        U.site(F.col("url")).alias("symbol"), U.normalize_url(F.col("url")).alias("url"), F.lit(0).alias("source_rank"),
        F.col("page_id").alias("place"), F.lit(0).cast("long").alias("score"), F.lit(0).alias("link_pos"))
    linked = page_links(spark, sf).select(
        U.site(F.col("base_url")).alias("symbol"), "url", F.lit(2).alias("source_rank"), F.col("page_id").alias("place"),
        "score", "link_pos")
    order = [F.col("source_rank"), F.col("place"), F.col("score").desc(), F.col("link_pos")]
    ranked = web.rank_candidates(own.unionByName(linked), order, 55)
    return ranked.select("symbol", "url", F.col("candidate_rank").cast("long").alias("candidate_rank"))


@query("url_forms", f"""SELECT page_id, {S.normal_url("url")} AS url,
  regexp_extract(regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', ''), '^(.*)$', 1)
    || CASE WHEN regexp_matches(url, '^[a-z]+://[^/?#]*([?#]|$)') THEN '/' ELSE '' END AS homepage,
  regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') AS domain,
  {S.ORIGIN.format('url')} || '/operations/?all=1' AS landing
FROM pages""")
def url_forms(spark, sf):
    u = F.col("url")
    return pages(spark, sf).select(
        "page_id", U.normalize_url(u).alias("url"), U.normalize_homepage(u).alias("homepage"), U.domain(u).alias("domain"),
        U.path_url(u, F.lit("/x/../operations/?all=1#top")).alias("landing"))


# Each page meets the page after it and, by turns, the domain of its own host and a longer name that ends alike.
@query("same_site_pages", f"""WITH s AS (SELECT page_id, url, {S.SITE.format('url')} AS site FROM pages),
near AS (
  SELECT a.page_id, a.site, b.site AS other, 'next' AS kind FROM s a JOIN s b ON b.page_id = a.page_id + 1
  UNION ALL SELECT page_id, site, CASE WHEN page_id % 2 = 0 THEN regexp_extract(site, '([^.]+\\.[^.]+\\.[^.]+)$', 1)
    ELSE 'x' || site END, 'made' FROM s)
SELECT page_id, kind, site <> '' AND other <> '' AND (
  site = other OR ends_with(site, '.' || other) OR ends_with(other, '.' || site)) AS same FROM near""")
def same_site_pages(spark, sf):
    found = pages(spark, sf).select("page_id", "url")
    after = found.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("other"))
    site = U.site(F.col("url"))
    made = F.when(F.col("page_id") % 2 == 0, F.regexp_extract(site, r"([^.]+\.[^.]+\.[^.]+)$", 1)).otherwise(
        F.concat(F.lit("x"), site))
    made = F.when(made != "", F.concat(F.lit("https://"), made, F.lit("/"))).otherwise("")
    pairs = found.join(after, "page_id").withColumn("kind", F.lit("next")).unionByName(
        found.withColumn("other", made).withColumn("kind", F.lit("made")))
    return pairs.select("page_id", "kind", U.same_site(F.col("url"), F.col("other")).alias("same"))


CARDS = f"""{S.PAGES},
raw_cards AS (
  SELECT page_id, unnest(regexp_extract_all(html, '(?is)<article\\b[^>]*>.*?</article>|<li\\b[^>]*>.*?</li>|<div\\b[^>]*>.*?</div>|<section\\b[^>]*>.*?</section>')) AS block
  FROM pages),
cards AS (
  SELECT page_id, regexp_extract(block, '(?is)^<[a-z]+\\b([^>]*)>', 1) AS attrs,
    array_to_string({S.visible(S.live("regexp_replace(block, '(?is)^<[a-z]+[^>]*>|</[a-z]+>$', '', 'g')"))}, chr(10)) AS text
  FROM raw_cards),
flagged AS (
  SELECT *, {S.any_word('attrs', BLOCKS)} AND {S.count_terms("lower(attrs || ' ' || text)", TERMS)} >= 2
    AND length(text) > 80 AS likely FROM cards)"""


@query("project_cards", f"WITH {CARDS} SELECT * FROM flagged")
def project_cards(spark, sf):
    cards = pages(spark, sf).select("page_id", F.explode(H.project_cards(F.col("html"))).alias("c")).select(
        "page_id", F.col("c.attrs").alias("attrs"), H.html_text(F.col("c.body")).alias("text"))
    return cards.withColumn("likely", H.likely_block(F.col("attrs"), F.col("text"), BLOCKS, TERMS))


GENERIC_SQL = ("lower(trim({0})) IN ('overview', 'operations', 'projects', 'properties', 'portfolio', 'assets', 'our assets', "
               "'where we operate') OR " + S.any_word("lower({0})", [
                   "404", "error", "not found", "privacy", "contact", "news", "investors", "home"]))


def generic(x: str) -> str:
    return "(" + GENERIC_SQL.replace("{0}", x) + ")"


def name_sql(lines: str) -> str:
    early = f"list_filter({lines}[1:10], lambda s: length(s) BETWEEN 3 AND 90 AND NOT {generic('s')} AND {S.any_word('s', NOUNS)})"
    short = f"list_filter({lines}[1:6], lambda s: length(s) BETWEEN 3 AND 70 AND NOT {generic('s')})"
    return f"coalesce({early}[1], {short}[1], '')"


def cleaned_name_sql(x: str) -> str:
    tail = f"regexp_replace({S.clean(x)}, '(?i)\\b(overview|operations|portfolio|projects|properties|assets)$', '')"
    return f"substr(trim({tail}, ' -|'), 1, 120)"


INFERRED = f"""named AS (
  SELECT page_id, url, title, lines, {cleaned_name_sql("regexp_split_to_array(string_split(title, '|')[1], '\\s-\\s')[1]")} AS from_title,
    {cleaned_name_sql("replace(replace(regexp_extract(trim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '([^/]*)$', 1), '-', ' '), '_', ' ')")} AS from_slug
  FROM parts),
inferred AS (
  SELECT page_id, url, title, lines, CASE WHEN from_title <> '' AND NOT {generic('from_title')} THEN from_title
    WHEN from_slug <> '' AND NOT {generic('from_slug')} THEN from_slug ELSE {name_sql('lines')} END AS name FROM named)"""


@query("name_infer", f"""WITH {S.PAGES}, {INFERRED}
SELECT page_id, name, {name_sql('lines')} AS text_name, {generic('name')} AS is_generic FROM inferred""")
def name_infer(spark, sf):
    parts = web.page_parts(pages(spark, sf))
    named = parts.withColumn("name", T.inferred_name(U.path(F.col("url")), F.col("title"), F.col("lines")))
    return named.select("page_id", "name", T.project_name(F.col("lines"), NOUNS).alias("text_name"),
                        T.generic_name(F.col("name")).alias("is_generic"))


@query("page_else_card", f"""WITH {CARDS}, {INFERRED},
named_cards AS (
  SELECT page_id, text, {name_sql(S.lines('text'))} AS name FROM flagged WHERE likely),
good AS (SELECT * FROM named_cards WHERE name <> ''),
context AS (
  SELECT page_id, array_to_string(lines, chr(10)) AS text, name FROM inferred
  WHERE page_id NOT IN (SELECT page_id FROM good))
SELECT page_id, name AS project_name, text AS evidence, 'semantic_html' AS extraction_layer FROM good
UNION ALL SELECT page_id, name, text, 'page_context' FROM context
WHERE length(text) > 250 AND {S.count_terms('lower(text)', TERMS)} > 0 AND name <> ''""")
def page_else_card(spark, sf):
    return web.page_blocks(pages(spark, sf), WORDS).select("page_id", "project_name", "evidence", "extraction_layer")


# Field extraction from the documents.

PHRASES = [
    (" the ", " gold project located in "),
    (" and ", " indicated and inferred "),
    (" of ", " Nevada "),
    (" on ", " 51% owned "),
    (" is ", " open pit development "),
    (" for ", " technical report https://x.org/report.pdf "),
    (" with ", ". Geology hosted "),
    (" en ", " M&I 43-101 wholly owned "),
    (" der ", " near Peru feasibility study! "),
    (" que ", " NI 43-101 resource  "),
]


def mined(spark, sf):
    text = F.regexp_replace("text", r"[^\x00-\x7F]", "a")
    for old, new in PHRASES:
        text = F.replace(text, F.lit(old), F.lit(new))
    return texts(spark, sf, "documents").select("doc_id", "source", "lang", text.alias("evidence"))


_MINED = "regexp_replace(text, '[^\\x00-\\x7F]', 'a', 'g')"
for _old, _new in PHRASES:
    _MINED = f"replace({_MINED}, '{_old}', '{_new}')"
MINED = f"mined AS (SELECT doc_id, source, lang, {_MINED} AS evidence FROM documents)"

OWNERSHIP = (r"(?i)\b(?:\d{1,3}(?:\.\d+)?%|(?:wholly owned|joint venture|owns?|ownership|stream|royalty)\b)[^.]{0,180}")
PLACES = ("Nevada|Ontario|Quebec|British Columbia|Mexico|Peru|Chile|Ghana|South Africa|Australia|Brazil|Argentina|Colombia|"
          "United States|Canada|Idaho|Alaska|Arizona|California|Colorado|Montana|New Mexico|Oregon|Utah|Washington|Wyoming")
LOCATION = rf"(?i)\b(?:located|location|in|near)\b[^.]{{0,120}}\b(?:{PLACES})\b"
STATUS = (r"(?i)\b(?:production|producing|operating|development|exploration|advanced exploration|permitting|feasibility|"
          r"construction)\b")
STYLE = r"(?i)\b(?:open pit|underground|heap leach|milling|processing|placer|surface mine|bulk underground)\b"
RESOURCE = r"(?i)\b(?:measured and indicated|M&I|indicated|inferred)\b[^.]{0,240}"
GEOLOGY = r"(?i)\b(?:geology|geological|mineralization|mineralisation|deposit|vein|orebody|hosted)\b"
REPORT = (r"(?i)[^.\n]{0,80}\b(?:NI 43-101|SK-1300|technical report|feasibility study|PEA|preliminary economic assessment)\b"
          r"[^.\n]{0,120}")
REPORT_URL = r"(?i)\b(?:pdf|technical|report|43-101|sk-1300|feasibility|pea)\b"
EVIDENCE = r"(?i)\b(?:resource|reserve|geology|ownership|technical report)\b"


def first_sql(pattern: str) -> str:
    return f"regexp_extract(evidence, '{pattern}')"


@query("field_extract", f"""WITH {MINED},
raw AS (SELECT doc_id, {first_sql(OWNERSHIP)} AS o, {first_sql(LOCATION)} AS l, {first_sql(STATUS)} AS s,
  {first_sql(STYLE)} AS m FROM mined)
SELECT doc_id, {S.trim_text('o', 500)} AS ownership, {S.trim_text('l', 500)} AS location,
  {S.trim_text('s', 500)} AS status, {S.trim_text('m', 500)} AS mining_style FROM raw""")
def field_extract(spark, sf):
    e = F.col("evidence")
    return mined(spark, sf).select(
        "doc_id", T.first_match(e, T.ownership_pattern()).alias("ownership"), T.first_match(e, T.LOCATION).alias("location"),
        T.first_match(e, T.STATUS).alias("status"), T.first_match(e, T.MINING_STYLE).alias("mining_style"))


@query("resource_text", f"""WITH {MINED},
hits AS (SELECT doc_id, regexp_extract_all(evidence, '{RESOURCE}') AS hits FROM mined),
kept AS (
  SELECT doc_id, array_to_string(list_filter(hits, lambda h: contains(lower(h), 'measured') OR contains(lower(h), 'indicated')
      OR contains(lower(h), 'm&i'))[1:3], ' ') AS m,
    array_to_string(list_filter(hits, lambda h: contains(lower(h), 'inferred'))[1:3], ' ') AS i FROM hits)
SELECT doc_id, {S.trim_text('m', 500)} AS measured, {S.trim_text('i', 500)} AS inferred FROM kept""")
def resource_text(spark, sf):
    e = F.col("evidence")
    return mined(spark, sf).select("doc_id", T.resource_text(e, "measured").alias("measured"),
                                   T.resource_text(e, "inferred").alias("inferred"))


@query("topic_sentences", f"""WITH {MINED},
cut AS (SELECT doc_id, string_split(regexp_replace({S.squeeze('evidence')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM mined),
kept AS (SELECT doc_id, array_to_string(list_filter(s, lambda x: regexp_matches(x, '{GEOLOGY}'))[1:5], ' ') AS g FROM cut)
SELECT doc_id, {S.trim_text('g', 900)} AS geology_text FROM kept""")
def topic_sentences(spark, sf):
    return mined(spark, sf).select("doc_id", T.topic_sentences(F.col("evidence")).alias("geology_text"))


def unique_sql(arr: str) -> str:
    """First ten distinct clean values in order, as JSON text."""
    c = f"list_filter(list_transform({arr}, lambda x: {S.squeeze('x')}), lambda x: x <> '')"
    return (f"list_filter({c}, lambda x, i: list_position({c}, x) = i)[1:10]")


@query("reports", f"""WITH {MINED},
found AS (
  SELECT doc_id, regexp_extract_all(evidence, '{REPORT}') AS n,
    list_filter(regexp_extract_all(evidence, 'https?://[^\\s"'')<>]+'), lambda u: regexp_matches(u, '{REPORT_URL}')) AS u
  FROM mined)
SELECT doc_id, array_to_string({unique_sql('n')}, ' | ') AS report_names, array_to_string({unique_sql('u')}, ' | ') AS report_urls
FROM found""")
def reports(spark, sf):
    e = F.col("evidence")
    return mined(spark, sf).select("doc_id", F.array_join(T.report_names(e), " | ").alias("report_names"),
                                   F.array_join(T.report_urls(e), " | ").alias("report_urls"))


DESCRIBED = f"""lined AS (SELECT *, {S.lines('evidence')} AS lines FROM mined),
described AS (
  SELECT *, array_to_string(list_filter(lines, lambda x: length(x) > 45)[1:8], ' ') AS d FROM lined)"""


@query("description", f"WITH {MINED}, {DESCRIBED} SELECT doc_id, {S.trim_text('d', 1800)} AS description_text, "
                      f"{S.trim_text('evidence', 2400)} AS evidence_text FROM described")
def description(spark, sf):
    staged = mined(spark, sf).withColumn("lines", T.split_text_lines(F.col("evidence")))
    return staged.select("doc_id", T.description(F.col("lines")).alias("description_text"),
                         T.trim_text(F.col("evidence"), 2400).alias("evidence_text"))


SCORED = f"""{MINED}, {DESCRIBED},
scored AS (
  SELECT doc_id, source, lang, {S.trim_text('d', 1800)} AS description_text,
    least(0.98::DOUBLE, 0.42::DOUBLE + 0.18::DOUBLE + CASE WHEN d <> '' THEN 0.12::DOUBLE ELSE 0 END
      + CASE WHEN regexp_matches(evidence, '{LOCATION}') THEN 0.08::DOUBLE ELSE 0 END
      + CASE WHEN regexp_matches(evidence, '{STATUS}') THEN 0.06::DOUBLE ELSE 0 END
      + CASE WHEN regexp_matches(evidence, '{EVIDENCE}') THEN 0.08::DOUBLE ELSE 0 END
      + CASE WHEN source < 'm' THEN 0.06::DOUBLE ELSE 0 END) AS raw_score
  FROM described),
project AS (SELECT *, round(raw_score, 3) AS confidence, lang || ' Gold' AS project_name, source AS symbol FROM scored)"""


def blocks(spark, sf):
    """A document as a project block: its source is the company, its language names the project."""
    return mined(spark, sf).select(
        "doc_id", F.col("source").alias("symbol"), F.concat("lang", F.lit(" Gold projects")).alias("project_name"),
        "evidence",
        F.when(F.col("source") < "m", F.lit("semantic_html")).otherwise(F.lit("page_context")).alias("extraction_layer"),
        F.concat(F.lit("https://x.org/"), F.col("doc_id").cast("string")).alias("source_url"))


def project_rows(spark, sf):
    return web.with_project_fields(blocks(spark, sf))


@query("confidence", f"WITH {SCORED} SELECT doc_id, symbol, project_name, confidence FROM project")
def confidence(spark, sf):
    return project_rows(spark, sf).select("doc_id", "symbol", "project_name", "confidence")


@query("keep_best", f"""WITH {SCORED}
SELECT symbol, project_name, doc_id, confidence, description_text FROM project
QUALIFY row_number() OVER (PARTITION BY symbol, lower(project_name)
  ORDER BY confidence + length(description_text) / 10000.0::DOUBLE DESC, doc_id) = 1""")
def keep_best(spark, sf):
    best = web.keep_best(project_rows(spark, sf), [F.col("doc_id")])
    return best.select("symbol", "project_name", "doc_id", "confidence", "description_text")


@query("cap_sorted", f"""WITH {SCORED}
SELECT symbol, project_name, doc_id FROM project
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY project_name, 'https://x.org/' || doc_id) <= 40""")
def cap_sorted(spark, sf):
    named = blocks(spark, sf).withColumn("project_name", T.clean_project_name(F.col("project_name")))
    return web.cap_sorted(named, 40).select("symbol", "project_name", "doc_id")


@query("min_confidence", f"""WITH {SCORED},
best AS (SELECT * FROM project QUALIFY row_number() OVER (PARTITION BY symbol, lower(project_name)
  ORDER BY confidence + length(description_text) / 10000.0::DOUBLE DESC, doc_id) = 1)
SELECT symbol, count(*) AS n FROM best WHERE confidence >= 0.8 GROUP BY symbol""")
def min_confidence(spark, sf):
    best = web.keep_best(project_rows(spark, sf), [F.col("doc_id")])
    return best.filter(F.col("confidence") >= 0.8).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
