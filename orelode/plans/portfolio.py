"""Website project portfolio: companies and page snapshots to project rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.functions.times import moment
from orelode.functions.urls import normalize_url
from orelode.operators import coverage, web
from orelode.operators.ranking import keep_first
from orelode.session import settle, spread

#: Columns that need no text of a block.
WITHOUT_TEXTS = ["symbol", "company_name", "short_name", "metal", "company_type", "project_name", "project_url", "source_url",
                 "retrieved_at", "confidence", "extraction_layer", "status_code", "error_message"]


def page_snapshot(pages: DataFrame, name: str, buckets: int = 64) -> DataFrame:
    """``url, html`` written as the table ``name``, dealt out and sorted by the normal form of the URL.

    A join on ``url`` with any table then moves that table only: neither the pages nor their HTML are shuffled
    again, and homepages, landing pages and candidate pages meet them by merge joins. Give as many buckets as
    make each some hundred megabytes. Replaces a table of this name.
    """
    keyed = pages.select(normalize_url(F.col("url")).alias("url"), "html").repartition(buckets, "url")
    keyed.write.bucketBy(buckets, "url").sortBy("url").mode("overwrite").saveAsTable(name)
    return pages.sparkSession.table(name)


def project_portfolio(companies: DataFrame, curated: DataFrame, discovered: DataFrame, pages: DataFrame,
                      known: DataFrame | web.SitePaths, landing: DataFrame, retrieved_at, common: list[str] | None = None,
                      vocabulary: web.Vocabulary = web.MINING, min_confidence: float = 0.52,
                      project_cap: int = 40, cap: int = 55, landing_cap: int = 10,
                      snapshot: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Project rows of all companies, and a status row for each company without any.

    Tables are written on the way: the companies with their homepage, the candidate URLs, the blocks of the pages and the chosen
    blocks of each company. A page is parsed once for links and once for projects, and only if a company names it. A block is scored
    once, however many companies name its page, and a company's blocks are chosen by name and score alone. The texts of
    blocks meet the companies' rows in the last join, so they are shuffled once for each block and never for each
    company. With ``columns`` there are only these; if all of them are
    among ``WITHOUT_TEXTS`` no page is parsed for texts. At the default ``min_confidence`` no found row is
    dropped, as the lowest possible score is 0.60. With ``snapshot`` the pages are a table of ``page_snapshot``,
    whose URLs are in normal form already; blocks are not written then, as chosen ones are read from the pages again.
    """
    stands = snapshot
    keyed = pages.select("url", "html") if snapshot else pages.select(normalize_url(F.col("url")).alias("url"), "html")

    # The homepage itself must be in the snapshot; a company without it has failed.
    # The company table is short next to the pages, so only URLs that are a homepage are counted.
    homes = settle(
        coverage.resolve_homepages(companies, curated, discovered)
        .withColumn("home_key", normalize_url(F.col("homepage_url"))), "homepages")
    snapshot = keyed.select(F.col("url").alias("home_key")).join(
        homes.select("home_key"), "home_key", "left_semi").distinct().withColumn("fetched", F.lit(True))
    placed = settle(homes.join(snapshot, "home_key", "left").drop("home_key"), "companies")
    reachable = placed.filter(F.col("fetched").isNotNull())
    candidates = settle(web.candidate_urls(reachable, keyed, known, landing, common, vocabulary, landing_cap, cap), "candidates")

    known_pages = keyed.withColumn("page", F.xxhash64("html"))

    def blocks_of(urls: DataFrame) -> DataFrame:
        wanted = known_pages.join(urls.select("url").distinct(), "url", "left_semi")
        return web.with_project_fields(web.page_blocks(wanted, vocabulary), vocabulary.verbatim)

    short = ["project_name", "confidence", "extraction_layer"]
    texts = columns is None or not set(columns) <= set(WITHOUT_TEXTS)
    blocks = blocks_of(candidates)
    if texts and not stands:
        blocks = settle(blocks.select(*web.BLOCK, "page_title", "project_name", *web.PROJECT_COLUMNS[10:23]), "blocks")
    scored = blocks.select(*web.BLOCK, *short, web.row_score().alias("score"))
    owned = spread(candidates.select("symbol", "url", "candidate_rank")).join(scored, "url")
    best = web.keep_best(owned, [F.col("candidate_rank"), F.col("block_pos"), F.col("page")], F.col("score"))
    chosen = web.cap_sorted(best.withColumn("source_url", F.col("url")), project_cap).filter(F.col("confidence") >= min_confidence)
    given = {"project_url": F.col("url"), "source_url": F.col("url"), "retrieved_at": moment(retrieved_at),
             "status_code": F.lit("found"), "error_message": F.lit("")}
    if texts:
        chosen = settle(chosen.select("symbol", *web.BLOCK), "chosen")
        # pages with the same URL and HTML have the same blocks
        each = keep_first(blocks_of(chosen) if stands else blocks, web.BLOCK, [F.col("block_pos")])
        blocks = each.select(*web.BLOCK, *(given.get(c, F.col(c)).alias(c) for c in web.PROJECT_COLUMNS[5:]))
    else:
        blocks = None
        chosen = chosen.select("symbol", *(
            given.get(c, F.col(c) if c in short else F.lit("")).alias(c) for c in web.PROJECT_COLUMNS[5:]))

    no_url = F.col("homepage_url").isNull()
    reasons = placed.withColumn(
        "status_code", F.when(no_url | F.col("fetched").isNotNull(), F.lit("not_found")).otherwise(F.lit("failed"))
    ).withColumn(
        "error_message",
        F.when(no_url, F.lit("No homepage URL available"))
        .when(F.col("fetched").isNull(), F.lit("homepage is not in the page snapshot"))
        .otherwise(F.lit("No portfolio project pages found")))
    rows = web.with_status_rows(reasons, chosen, retrieved_at, blocks)
    return rows if columns is None else rows.select(*columns)
