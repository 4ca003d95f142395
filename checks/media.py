"""Mentions, sentiment and lookups on ``documents``.

The benchmark items are the symbols: their aliases are the first two, three and seven
words of the item, their context is the fifth word. A label gives the sentiment of a document.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, table, texts
from orelode.operators import media, near, preparation


def symbols(spark, sf):
    w = media.tokens(F.col("text"))
    return table(spark, sf, "benchmark").select(
        F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("symbol"), w.alias("w")).select(
        "symbol", F.array(*(F.array_join(F.slice("w", 1, n), " ") for n in (2, 3, 7))).alias("aliases"),
        F.when(F.get("w", F.lit(4)).isNotNull(), F.array(F.get("w", F.lit(4)))).alias("context"))


MENTIONS = """words AS (
  SELECT 'B' || item_id AS symbol, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
alias AS (
  SELECT DISTINCT symbol, unnest([lower(symbol), array_to_string(w[1:2], ' '), array_to_string(w[1:3], ' '),
    array_to_string(w[1:7], ' ')]) AS phrase FROM words),
docw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
tok AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docw),
gram AS (
  SELECT doc_id, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM tok, (SELECT unnest(range(1, 8)) AS n)
  WHERE i + n - 1 <= len(w)),
hits AS (SELECT doc_id, symbol, count(*) AS occurrences FROM gram JOIN alias USING (phrase) GROUP BY ALL),
found AS (
  SELECT h.doc_id, h.symbol, h.occurrences FROM hits h JOIN words s USING (symbol) JOIN docw d USING (doc_id)
  WHERE len(s.w) < 5 OR list_contains(d.w, s.w[5]))"""


def found(spark, sf):
    return media.mentions(texts(spark, sf, "documents"), media.phrases(symbols(spark, sf)))


@query("mentions", f"WITH {MENTIONS} SELECT * FROM found")
def mentions(spark, sf):
    return found(spark, sf)


@query("mention_counts", f"""WITH {MENTIONS}
SELECT symbol, source, count(*) AS mentions, round(sum(1 + log10(occurrences)), 6) AS weight
FROM found JOIN documents USING (doc_id) GROUP BY ALL""")
def mention_counts(spark, sf):
    where = table(spark, sf, "documents").select("doc_id", "source")
    return media.mention_counts(found(spark, sf).join(where, "doc_id"), "source")


@query("one_per_text", """SELECT min(doc_id) AS doc_id FROM documents
GROUP BY regexp_replace(trim(lower(text), ' '), '\\s+', ' ', 'g')""")
def one_per_text(spark, sf):
    return media.first_copies(texts(spark, sf, "documents"))


@query("distinct_mention_counts", f"""WITH {MENTIONS},
firsts AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY regexp_replace(trim(lower(text), ' '), '\\s+', ' ', 'g'))
SELECT symbol, count(*) AS mentions, round(sum(1 + log10(occurrences)), 6) AS weight
FROM found SEMI JOIN firsts USING (doc_id) GROUP BY ALL""")
def distinct_mention_counts(spark, sf):
    firsts = media.first_copies(texts(spark, sf, "documents"))
    return media.mention_counts(found(spark, sf).join(firsts, "doc_id", "left_semi"))


@query("sentiment_trend", """WITH s AS (
  SELECT source AS company, lang AS commodity, doc_id // 100 AS period,
    CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 ELSE 0 END AS score FROM documents JOIN labels USING (doc_id)),
g AS (
  SELECT CASE WHEN grouping(company) = 0 THEN 'company' WHEN grouping(commodity) = 0 THEN 'commodity' ELSE 'all' END AS axis,
    CASE WHEN grouping(company) = 0 THEN company WHEN grouping(commodity) = 0 THEN commodity ELSE 'all' END AS value,
    period, round(avg(score), 6) AS mean_score, count(*) AS n
  FROM s GROUP BY GROUPING SETS ((period, company), (period, commodity), (period))),
d AS (SELECT *, round(mean_score - lag(mean_score) OVER (PARTITION BY axis, value ORDER BY period), 6) AS delta FROM g)
SELECT *, CASE WHEN delta > 0.1 THEN 'improving' WHEN delta < -0.1 THEN 'deteriorating' ELSE 'stable' END AS trend FROM d""")
def sentiment_trend(spark, sf):
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("company"), F.col("lang").alias("commodity"))
    scored = docs.join(table(spark, sf, "labels"), "doc_id").select(
        "company", "commodity", F.floor(F.col("doc_id") / 100).cast("long").alias("period"),
        media.sentiment_score(label).alias("score"))
    return media.sentiment_trend(scored, ["company", "commodity"])


@query("symbol_canonical", """WITH listings AS (
  SELECT upper(p_brand) AS alias, upper(min(p_name)) AS canonical FROM part GROUP BY upper(p_brand))
SELECT coalesce(canonical, upper(trim(p_brand))) AS symbol, count(*) AS n FROM part LEFT JOIN listings ON alias = upper(trim(p_brand))
WHERE coalesce(canonical, upper(trim(p_brand))) IN (SELECT upper(p_name) FROM part WHERE p_type = 'ECONOMY') GROUP BY 1""")
def symbol_canonical(spark, sf):
    part = table(spark, sf, "part")
    listings = part.groupBy(F.upper("p_brand").alias("alias")).agg(F.upper(F.min("p_name")).alias("canonical"))
    sector = part.filter(F.col("p_type") == "ECONOMY").select(F.upper("p_name").alias("symbol"))
    rows = part.select(F.concat(F.lower("p_brand"), F.lit(" ")).alias("symbol"))
    return media.canonical_symbols(rows, listings, sector).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("entity_lookup", "SELECT CAST(p_partkey AS VARCHAR) AS symbol, p_name AS name FROM part "
                        "WHERE contains(lower(p_name), 'ring') OR CAST(p_partkey AS VARCHAR) = 'ring'")
def entity_lookup(spark, sf):
    companies = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("symbol"), F.col("p_name").alias("name"))
    return media.entity_lookup(companies, " Ring ")


@query("boilerplate_lines", """WITH lines AS (
  SELECT doc_id, sha256(text) AS copy,
    unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')))) AS line FROM documents),
frequent AS (
  SELECT line FROM lines WHERE line <> '' GROUP BY line
  HAVING count(DISTINCT copy) >= 5 AND count(DISTINCT copy) > 0.01::DOUBLE * (SELECT count(*) FROM documents)),
cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS old, coalesce((SELECT list(line) FROM frequent), []) AS f FROM documents),
kept AS (SELECT doc_id, old, list_filter(old, lambda x: NOT list_contains(f, trim(x, ' '))) AS new FROM cut)
SELECT doc_id, array_to_string(new, chr(10)) AS text, len(old) - len(new) AS dropped FROM kept""")
def boilerplate_lines(spark, sf):
    return preparation.without_boilerplate(texts(spark, sf, "documents"), 5)


@query("near_dedupe", """WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x09-\\x0D ]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
    lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM w WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT u, v FROM common JOIN size a ON a.doc_id = u JOIN size b ON b.doc_id = v WHERE c >= 0.8::DOUBLE * (a.n + b.n - c)),
reach AS (SELECT u, u AS v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u)
SELECT doc_id, coalesce(min(v), doc_id) AS class_id FROM documents LEFT JOIN reach ON u = doc_id GROUP BY doc_id""")
def near_dedupe(spark, sf):
    return near.near_copies(texts(spark, sf, "documents"))


@query("noise_filter", """SELECT doc_id FROM documents
WHERE length(text) >= 20 AND length(regexp_replace(text, '[^\\p{L}]', '', 'g')) >= 0.6::DOUBLE * length(text)""")
def noise_filter(spark, sf):
    docs = texts(spark, sf, "documents")
    return docs.filter(preparation.is_prose(F.col("text"))).select("doc_id")
