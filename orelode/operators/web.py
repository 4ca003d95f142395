"""Project pages of company sites: link discovery, extraction, best rows, status rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode import dims
from orelode.functions import html as H
from orelode.functions import text as T
from orelode.functions import urls as U
from orelode.functions.times import moment
from orelode.operators.ranking import keep_first, top_n_per
from orelode.session import spread


@dataclass(frozen=True)
class Vocabulary:
    """Word lists of the extraction; the defaults are the mining ones."""

    link_terms: list[str] = field(default_factory=lambda: dims.LINK_TERMS)
    negative_terms: list[str] = field(default_factory=lambda: dims.NEGATIVE_TERMS)
    anchor_words: list[str] = field(default_factory=lambda: dims.ANCHOR_WORDS)
    block_words: list[str] = field(default_factory=lambda: dims.BLOCK_WORDS)
    name_nouns: list[str] = field(default_factory=lambda: dims.NAME_NOUNS)
    verbatim: bool = False
    # also look for report documents among the link targets of a block
    link_reports: bool = False


MINING = Vocabulary()


def page_parts(pages: DataFrame) -> DataFrame:
    """``url, title, links, lines`` of each page; the HTML is dropped."""
    return pages.withColumn("live", H.live_html(F.col("html"))).select(
        *[c for c in pages.columns if c != "html"],
        H.page_title(F.col("live")).alias("title"),
        H.page_links(F.col("live")).alias("links"),
        H.page_lines(F.col("live")).alias("lines"))


def scored_links(bases: DataFrame, vocabulary: Vocabulary = MINING) -> DataFrame:
    """Links worth following. ``bases`` has ``base_url`` and ``links``; its other columns stay.

    Links are resolved, judged and scored inside the row; only the good ones leave it.
    """
    base = F.col("base_url")
    resolved = F.transform("links", lambda a, i: F.struct(
        i.alias("link_pos"), U.normalize_url(U.join_url(base, a["href"])).alias("url"), a["text"].alias("link_text")))
    own = F.filter(resolved, lambda a: U.same_site(base, a["url"]) & ~U.unwanted_url(a["url"], vocabulary.negative_terms))
    scored = F.transform(own, lambda a: F.struct(
        a["link_pos"].alias("link_pos"), a["url"].alias("url"), a["link_text"].alias("link_text"),
        U.link_score(a["link_text"], a["url"], vocabulary.link_terms, vocabulary.anchor_words).alias("score")))
    return bases.select(*[c for c in bases.columns if c != "links"], F.inline(F.filter(scored, lambda a: a["score"] > 0)))


def rank_candidates(candidates: DataFrame, order: list[Column], cap: int = 55) -> DataFrame:
    """Candidate URLs per company, first occurrence kept, at most ``cap``, ranked from 1."""
    once = keep_first(candidates, ["symbol", "url"], order)
    return top_n_per(once, ["symbol"], order, cap, keep_rank="candidate_rank")


@dataclass(frozen=True)
class SitePaths:
    """Known project pages listed by site, for sites that many companies share.

    ``owners`` has ``symbol`` and ``site``, ``paths`` has ``site``, ``pos`` and ``path``. A site's list is made into URLs
    once and cut to the cap before the companies of the site get it, so work grows with the list and the
    companies, not with their product.
    """

    owners: DataFrame
    paths: DataFrame


def site_candidates(base: DataFrame, known: SitePaths, place: Column, cap: int) -> DataFrame:
    """``symbol, url, place`` of known pages: of each site the first ``cap`` different URLs, for ``base`` (symbol, homepage_url)."""
    rooted = base.join(known.owners, "symbol").select(
        "symbol", "site", F.regexp_extract(U.with_scheme(F.col("homepage_url")), r"^([^:/?#]+://[^/?#]*)", 1).alias("root")).distinct()
    listed = rooted.select("site", "root").distinct().join(known.paths, "site").select(
        "site", "root", U.path_url(F.col("root"), F.col("path")).alias("url"), place)
    order = [F.col("place")]
    firsts = top_n_per(keep_first(listed, ["site", "root", "url"], order), ["site", "root"], order, cap)
    return rooted.join(firsts, ["site", "root"]).select("symbol", "url", "place")


def path_candidates(companies: DataFrame, known: DataFrame | SitePaths, landing: DataFrame, common: list[str],
                    cap: int = 55) -> DataFrame:
    """URLs made of listed site paths: known project pages, then landing pages.

    ``source_rank`` is 0 for project pages and 1 for landing pages; ``place`` keeps
    the list order, a company's own landing pages before the common ones. Of pages known by site
    (``SitePaths``) a company gets the first ``cap`` of the site.
    """
    base = companies.select("symbol", "homepage_url")

    def place(group: int, pos: Column) -> Column:
        return F.struct(F.lit(group).alias("list"), pos.cast("int").alias("pos")).alias("place")

    def listed(paths: DataFrame, rank: int) -> DataFrame:
        return base.join(paths, "symbol").select(
            "symbol", U.path_url(F.col("homepage_url"), F.col("path")).alias("url"),
            F.lit(rank).alias("source_rank"), place(0, F.col("pos")))

    shared = base.select(
        "symbol", "homepage_url", F.posexplode(F.array(*[F.lit(p) for p in common])).alias("pos", "path")
    ).select("symbol", U.path_url(F.col("homepage_url"), F.col("path")).alias("url"), F.lit(1).alias("source_rank"),
             place(1, F.col("pos")))
    if isinstance(known, SitePaths):
        projects = site_candidates(base, known, place(0, F.col("pos")), cap).withColumn("source_rank", F.lit(0))
    else:
        projects = listed(known, 0)
    return projects.unionByName(listed(landing, 1)).unionByName(shared)


def candidate_urls(companies: DataFrame, pages: DataFrame, known: DataFrame | SitePaths, landing: DataFrame,
                   common: list[str] | None = None, vocabulary: Vocabulary = MINING,
                   landing_cap: int = 10, cap: int = 55) -> DataFrame:
    """Candidate project pages of each company: listed paths, then scored links.

    Links come from the homepage and from the first ``landing_cap`` landing pages.
    A page is parsed once, however many companies name it.
    """
    paths = path_candidates(companies, known, landing, common or dims.COMMON_LANDING_PATHS, cap)
    place = [F.col("source_rank"), F.col("place")]
    landings = top_n_per(
        keep_first(paths.filter(F.col("source_rank") == 1), ["symbol", "url"], place),
        ["symbol"], place, landing_cap, keep_rank="landing_no")
    bases = companies.select(
        "symbol", F.col("homepage_url").alias("base_url"), F.lit(2).alias("source_rank"), F.lit(0).alias("landing_no")
    ).unionByName(landings.select("symbol", F.col("url").alias("base_url"), F.lit(3).alias("source_rank"), "landing_no"))
    bases = bases.withColumn("page_url", U.normalize_url(F.col("base_url")))
    named = pages.join(bases.select(F.col("page_url").alias("url")).distinct(), "url", "left_semi")
    parsed = page_parts(named).select(F.col("url").alias("page_url"), "links")
    links = scored_links(bases.join(parsed, "page_url"), vocabulary).select(
        "symbol", "url", "source_rank", F.struct(F.lit(0).alias("list"), F.col("landing_no").alias("pos")).alias("place"),
        F.col("score").alias("score"), F.col("link_pos").alias("link_pos"))
    listed = paths.withColumn("score", F.lit(0).cast("long")).withColumn("link_pos", F.lit(0))
    order = [F.col("source_rank"), F.col("place"), F.col("score").desc(), F.col("link_pos")]
    return rank_candidates(listed.unionByName(links), order, cap)


def page_blocks(pages: DataFrame, vocabulary: Vocabulary = MINING) -> DataFrame:
    """Project blocks of each page: its cards, or the page itself where it has none.

    Rows carry ``url, page_title, block_pos, project_name, evidence, extraction_layer``.
    The choice is made inside the row, so the HTML is read once and never shuffled.
    With ``link_reports`` there are also the resolved link targets, as ``hrefs``.
    """
    base = F.col("url")

    def targets(links: Column) -> list[Column]:
        if not vocabulary.link_reports:
            return []
        return [F.transform(links, lambda a: U.join_url(base, a["href"])).alias("hrefs")]

    staged = pages.withColumn("live", H.live_html(F.col("html"))).select(
        *[c for c in pages.columns if c != "html"],
        H.page_title(F.col("live")).alias("page_title"),
        H.page_lines(F.col("live")).alias("lines"),
        F.transform(
            H.project_cards(F.col("html")),
            lambda b: F.struct(b["attrs"].alias("attrs"), H.html_text(b["body"]).alias("text"),
                               *targets(H.page_links(H.live_html(b["body"])))),
        ).alias("cards"),
        *targets(H.page_links(F.col("live"))),
    )
    carried = ["hrefs"] if vocabulary.link_reports else []
    likely = F.filter(
        F.col("cards"),
        lambda c: H.likely_block(c["attrs"], c["text"], vocabulary.block_words, vocabulary.link_terms))
    staged = staged.withColumn("cards", F.transform(
        likely,
        lambda c: F.struct(
            T.project_name(T.split_text_lines(c["text"]), vocabulary.name_nouns).alias("project_name"),
            c["text"].alias("evidence"), F.lit("semantic_html").alias("extraction_layer"),
            *[c[x].alias(x) for x in carried])))
    staged = staged.withColumn("cards", F.filter("cards", lambda c: c["project_name"] != ""))
    staged = staged.withColumn("page_text", F.array_join("lines", "\n"))
    whole = F.struct(
        T.inferred_name(U.path(F.col("url")), F.col("page_title"), T.split_text_lines(F.col("page_text")),
                        vocabulary.verbatim).alias("project_name"),
        F.col("page_text").alias("evidence"), F.lit("page_context").alias("extraction_layer"), *carried)
    context = F.when(H.substantive(F.col("page_text"), vocabulary.link_terms), F.array(whole))
    blocks = F.when(F.size("cards") > 0, F.col("cards")).otherwise(context)
    kept = [c for c in pages.columns if c != "html"]
    return staged.select(*kept, "page_title", F.posexplode(blocks).alias("block_pos", "block")).select(
        *kept, "page_title", "block_pos", "block.*").filter(F.col("project_name") != "")


def with_project_fields(blocks: DataFrame, verbatim: bool = False) -> DataFrame:
    """Fields read from the evidence text of each block, and the confidence."""
    evidence = F.col("evidence")
    report_links = T.report_urls(evidence)
    if "hrefs" in blocks.columns:
        named = F.filter("hrefs", lambda u: u.rlike(T.words(dims.REPORT_URL_WORDS)))
        report_links = T.clean_unique(F.concat(report_links, named), 10)
    staged = blocks.withColumn("evidence_lines", T.split_text_lines(evidence))
    staged = staged.select(
        "*",
        T.description(F.col("evidence_lines")).alias("description_text"),
        T.first_match(evidence, T.ownership_pattern(verbatim)).alias("ownership"),
        T.first_match(evidence, T.LOCATION).alias("location"),
        T.first_match(evidence, T.STATUS).alias("status"),
        T.first_match(evidence, T.MINING_STYLE).alias("mining_style"),
        T.resource_text(evidence, "measured").alias("measured_indicated_mineral_resources"),
        T.resource_text(evidence, "inferred").alias("inferred_mineral_resources"),
        T.topic_sentences(evidence).alias("geology_text"),
        T.json_array(T.report_names(evidence)).alias("technical_report_names_json"),
        T.json_array(report_links).alias("technical_report_urls_json"),
    ).drop("evidence_lines")
    return staged.withColumn(
        "confidence",
        T.confidence(F.col("project_name"), F.col("description_text"), F.col("location"), F.col("status"),
                     evidence, F.col("extraction_layer")),
    ).withColumn("project_name", T.clean_project_name(F.col("project_name"))).withColumn(
        "evidence_text", T.trim_text(evidence, 2400)).drop("evidence")


def row_score() -> Column:
    return F.col("confidence") + F.length("description_text") / F.lit(10000.0)


def keep_best(rows: DataFrame, seen: list[Column], score: Column | None = None) -> DataFrame:
    """Best row per company and project name, by ``row_score`` or the given one; of equals the first seen."""
    keyed = rows.withColumn("name_key", F.lower("project_name"))
    best = row_score() if score is None else score
    return keep_first(keyed, ["symbol", "name_key"], [best.desc(), *seen]).drop("name_key")


def cap_sorted(rows: DataFrame, cap: int = 40) -> DataFrame:
    """First ``cap`` projects of each company by name."""
    return top_n_per(rows, ["symbol"], [F.col("project_name"), F.col("source_url")], cap)


PROJECT_COLUMNS = [
    "symbol", "company_name", "short_name", "metal", "company_type", "project_name", "project_url", "source_url",
    "page_title", "retrieved_at", "description_text", "ownership", "location", "status", "mining_style",
    "measured_indicated_mineral_resources", "inferred_mineral_resources", "geology_text",
    "technical_report_names_json", "technical_report_urls_json", "evidence_text", "confidence", "extraction_layer",
    "status_code", "error_message",
]


#: What tells a project block from all others: the URL and a hash of its page, and its place there.
BLOCK = ["url", "page", "block_pos"]


def with_status_rows(companies: DataFrame, projects: DataFrame, retrieved_at, blocks: DataFrame | None = None) -> DataFrame:
    """Project rows, and one status row for each company without any.

    ``companies`` has ``homepage_url``, ``status_code`` and ``error_message``: what to
    report if no project of the company was found. One outer join does both, so
    the projects are worked out once. With ``blocks``, a row for each ``BLOCK``, ``projects`` has ``symbol`` and ``BLOCK`` alone, and
    what else there is of a project is looked up last: the texts of a block move once, not once for each company.
    """
    own = {"symbol", "company_name", "short_name", "metal", "company_type"}
    url = F.coalesce("homepage_url", F.lit(""))
    given = {
        "project_url": url, "source_url": url, "retrieved_at": moment(retrieved_at), "confidence": F.lit(0.0),
        "technical_report_names_json": F.lit("[]"), "technical_report_urls_json": F.lit("[]"),
        "extraction_layer": F.lit("status"),
        "status_code": F.col("why_code"), "error_message": F.col("why_message"),
    }
    found = [c for c in PROJECT_COLUMNS if c not in own]
    known = companies.select(
        *[c for c in PROJECT_COLUMNS if c in own], "homepage_url",
        F.col("status_code").alias("why_code"), F.col("error_message").alias("why_message"))
    told = found if blocks is None else BLOCK
    owned = projects.select("symbol", *told, F.lit(True).alias("has_project"))
    joined = known.join(owned if blocks is None else spread(owned), "symbol", "left")
    if blocks is not None:  # rows without a block must not all meet at the null key
        row = F.xxhash64(*known.columns).cast("string")
        joined = joined.withColumn("url", F.coalesce("url", row)).join(blocks.select(*BLOCK, *found), BLOCK, "left")
    return joined.select(*[
        F.col(c) if c in own
        else F.when(F.col("has_project").isNotNull(), F.col(c)).otherwise(given.get(c, F.lit(""))).alias(c)
        for c in PROJECT_COLUMNS])


def project_status(rows: DataFrame) -> DataFrame:
    """Per company: outcome and number of projects."""
    return rows.groupBy("symbol").agg(
        F.min("status_code").alias("status"), F.count_if(F.col("status_code") == "found").alias("projects"))
