"""Homepage coverage: the customers are the companies, pages their homepages."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import plain, query, table
from orelode.operators import coverage
from orelode.operators.health import count_by, recent
from orelode.plans import jobs

AT = "2024-01-31T00:00:00Z"


def universe(spark, sf):
    nation = table(spark, sf, "nation")
    return table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.upper("c_name").alias("symbol"), F.col("c_name").alias("name"), F.col("n_name").alias("metal"),
        F.nullif(F.lower("c_mktsegment"), F.lit("machinery")).alias("company_type"))


def curated(spark, sf):
    """Page n is the homepage of customer n; half of them are written without a scheme."""
    url = F.col("url")
    page = table(spark, sf, "pages").select(
        F.col("page_id").alias("c_custkey"),
        F.when(url.startswith("https://"), F.substring(url, F.lit(9), F.length(url))).otherwise(url).alias("url"))
    return table(spark, sf, "customer").join(page, "c_custkey").select(F.upper("c_name").alias("symbol"), "url")


def requests(spark, sf):
    """Supplier names and customer names, so that some are not in the universe."""
    return table(spark, sf, "customer").select(F.upper("c_name").alias("symbol")).unionByName(
        table(spark, sf, "supplier").select(F.upper("s_name").alias("symbol")))


ROWS = """bare AS (
  SELECT page_id, url, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS tail,
    CASE WHEN starts_with(url, 'http://') THEN 'http://' ELSE 'https://' END AS scheme FROM pages),
home AS (
  SELECT page_id, scheme || tail || CASE WHEN contains(tail, '/') THEN '' ELSE '/' END AS homepage_url,
    regexp_replace(regexp_extract(tail, '^[^/]*'), '^www\\.', '') AS domain FROM bare),
asked AS (
  SELECT upper(c_name) AS symbol, c_name AS name, n_name AS metal, nullif(lower(c_mktsegment), 'machinery') AS company_type,
    h.homepage_url, h.domain, TRUE AS known
  FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN home h ON h.page_id = c_custkey
  UNION ALL SELECT upper(s_name), NULL, NULL, NULL, NULL, NULL, FALSE FROM supplier),
rows AS (
  SELECT symbol, name AS company_name, name, name AS short_name, metal, company_type, homepage_url,
    domain AS matched_domain, domain AS homepage_domain,
    CASE WHEN homepage_url IS NOT NULL THEN 0.98::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
    CASE WHEN NOT known THEN 'not_in_universe' WHEN homepage_url IS NOT NULL THEN 'found' ELSE 'not_found' END AS status,
    CASE WHEN homepage_url IS NOT NULL THEN 'curated' WHEN known THEN 'missing_curated_url' END AS match_method,
    CASE WHEN homepage_url IS NOT NULL THEN 'curated_homepage_map' WHEN known THEN 'company_universe' END AS source,
    CASE WHEN homepage_url IS NOT NULL THEN name || ' official homepage' END AS source_title,
    CASE WHEN homepage_url IS NOT NULL THEN 'Curated homepage URL.' END AS source_snippet,
    name || ' official homepage' AS search_query,
    CASE WHEN known THEN 'curated_homepage_map' END AS search_provider,
    CASE WHEN known AND homepage_url IS NULL THEN 'No curated homepage URL available.' END AS error_message,
    CASE WHEN known THEN '2024-01-31T00:00:00Z' END AS checked_at, '2024-01-31T00:00:00Z' AS generated_at
  FROM asked)"""


def rows(spark, sf):
    return coverage.homepage_rows(requests(spark, sf), universe(spark, sf), curated(spark, sf), AT)


@query("homepage_rows", f"WITH {ROWS} SELECT * FROM rows")
def homepage_rows(spark, sf):
    return plain(rows(spark, sf))


@query("homepage_coverage", f"""WITH {ROWS} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'found') AS found,
  count(*) FILTER (WHERE status <> 'found') AS missing FROM rows""")
def homepage_coverage(spark, sf):
    return coverage.coverage(rows(spark, sf))


@query("coverage_by_group", f"""WITH {ROWS} SELECT metal, count(*) AS total,
  count(*) FILTER (WHERE status = 'found') AS found, count(*) FILTER (WHERE status <> 'found') AS missing
FROM rows GROUP BY metal""")
def coverage_by_group(spark, sf):
    return coverage.coverage_by(rows(spark, sf), "metal")


@query("coverage_sorted_limit", f"""WITH {ROWS} SELECT symbol, status FROM rows WHERE status <> 'not_in_universe'
ORDER BY symbol LIMIT 100""")
def coverage_sorted_limit(spark, sf):
    df = jobs.homepage_coverage(universe(spark, sf), curated(spark, sf), AT, limit=100)
    return df.select("symbol", "status")


@query("homepage_status_counts", f"WITH {ROWS} SELECT status, company_type, count(*) AS n FROM rows GROUP BY ALL")
def homepage_status_counts(spark, sf):
    return count_by(rows(spark, sf), "status", "company_type")


@query("recent_homepages", """SELECT upper(c_name) AS symbol, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS checked_at
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_name ORDER BY max(o_orderdate) DESC, symbol LIMIT 25""")
def recent_homepages(spark, sf):
    checked = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.upper("c_name").alias("symbol")).agg(F.max("o_orderdate").alias("checked_at"))
    return plain(recent(checked, "checked_at", "symbol", 25))


@query("resolve_homepages", f"""WITH {ROWS},
discovered AS (SELECT upper(c_name) AS symbol, 'https://found.example/' || c_nationkey AS url FROM customer WHERE c_acctbal > 0)
SELECT r.symbol, coalesce(r.homepage_url, d.url) AS homepage_url FROM rows r LEFT JOIN discovered d USING (symbol)
WHERE status <> 'not_in_universe'""")
def resolve_homepages(spark, sf):
    listed = rows(spark, sf)
    found = coverage.found_homepages(listed)
    discovered = table(spark, sf, "customer").filter(F.col("c_acctbal") > 0).select(
        F.upper("c_name").alias("symbol"),
        F.concat(F.lit("https://found.example/"), F.col("c_nationkey").cast("string")).alias("url"))
    companies = universe(spark, sf).select("symbol")
    return coverage.resolve_homepages(companies, found, discovered)
