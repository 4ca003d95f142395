"""Word lists, check settings and curated rows, and the small tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Fixed values. Results depend on them, and some on their order.
# ---------------------------------------------------------------------------

# name, file, category, threshold hours, feeds
WORKFLOWS = [
    ("Refresh Market History", "refresh-market-history.yml", "market", 30.0, "daily_ohlcv"),
    ("Refresh RSS News", "refresh-rss-news.yml", "news", 30.0, "rss/news tables"),
    ("Ingest YouTube Channel Transcripts", "ingest-youtube-channel-transcripts.yml", "youtube", 96.0,
     "youtube_videos/youtube_segments/youtube_transcripts"),
    ("EDGAR", "edgar.yml", "sec", 1800.0, "SEC/EDGAR disclosures"),
    ("Sync Company Homepages", "sync-company-homepages.yml", "company_web", 36.0, "company_homepages"),
    ("Sync Website Project Portfolio", "sync-website-project-portfolio.yml", "company_web", 240.0,
     "website_project_portfolio"),
    ("Sync Website Management Team", "sync-website-management-team.yml", "company_web", 36.0,
     "website_management_team"),
    ("Sync Website Investor News", "sync-website-investor-news.yml", "company_web", 36.0, "website_investor_news"),
]

# table, category, newest-row column, threshold hours, label
TABLE_CHECKS = [
    ("daily_ohlcv", "market", "date", 36.0, "Market history"),
    ("news_items", "news", "published_at", 72.0, "RSS/news items"),
    ("rss_news", "news", "published_at", 72.0, "RSS feed"),
    ("youtube_videos", "youtube", "published_at", 168.0, "YouTube videos"),
    ("youtube_transcripts", "youtube", "created_at", 336.0, "YouTube transcripts"),
    ("youtube_segments", "youtube", "created_at", 336.0, "YouTube segments"),
    ("company_homepages", "company_web", "checked_at", 72.0, "Company homepages"),
    ("website_project_portfolio", "company_web", "retrieved_at", 336.0, "Website project portfolio"),
    ("website_management_team", "company_web", "retrieved_at", 168.0, "Website management team"),
    ("website_investor_news", "company_web", "published_at", 168.0, "Website investor news"),
]

# name, search query (NULL where a handle URL is known), handle URL
CHANNELS = [
    ("Kitco News", None, "https://www.youtube.com/@kitco"),
    ("Kitco Mining", "Kitco Mining", None),
    ("Metals Investor Forum", "Metals Investor Forum", None),
    ("Commodity Culture", "Commodity Culture", None),
    ("Sprott Money", "Sprott Money", None),
    ("Mining Stocks Today", "Mining Stocks Today", None),
    ("Sprott", "Sprott", None),
    ("Rule Investment Media", "Rule Investment Media", None),
    ("Don Durrett", "Don Durrett", None),
    ("Mining Stock Education", "Mining Stock Education", None),
    ("Mining Stock Monkey", "Mining Stock Monkey", None),
    ("Crux Investor", "Crux Investor", None),
    ("Jay Martin Show", "Jay Martin Show", None),
    ("Liberty and Finance", "Liberty and Finance", None),
    ("Wealtheon", "Wealtheon", None),
]

KEYWORD_TAGS = [
    ("aem", ["AEM"]),
    ("agnico", ["AEM"]),
    ("wheaton", ["WPM"]),
    ("wpm", ["WPM"]),
    ("coeur", ["CDE"]),
    ("cde", ["CDE"]),
    ("newmont", ["NEM"]),
    ("nem", ["NEM"]),
    ("barrick", ["GOLD"]),
    ("gold", ["GOLD", "MINERS"]),
    ("silver", ["SILVER", "MINERS"]),
    ("copper", ["COPPER", "MINERS"]),
    ("uranium", ["URANIUM", "MINERS"]),
    ("lithium", ["LITHIUM", "MINERS"]),
    ("miner", ["MINERS"]),
    ("mining", ["MINERS"]),
]
DEFAULT_TAGS = ["GOLD", "SILVER", "MINERS"]

CURATED_HOMEPAGES = {
    "AEM": "https://www.agnicoeagle.com/",
    "AG": "https://www.firstmajestic.com/",
    "AGI": "https://www.alamosgold.com/",
    "ALB": "https://www.albemarle.com/",
    "AU": "https://www.anglogoldashanti.com/",
    "AYASF": "https://ayagoldsilver.com/",
    "BHP": "https://www.bhp.com/",
    "BTG": "https://www.b2gold.com/",
    "CCJ": "https://www.cameco.com/",
    "CDE": "https://www.coeur.com/",
    "CGAU": "https://www.centerragold.com/",
    "DNN": "https://www.denisonmines.com/",
    "DRD": "https://www.drdgold.com/",
    "EGO": "https://www.eldoradogold.com/",
    "EQX": "https://www.equinoxgold.com/",
    "FCX": "https://fcx.com/",
    "FSM": "https://fortunamining.com/",
    "GFI": "https://www.goldfields.com/",
    "GLDG": "https://www.goldmining.com/",
    "HL": "https://www.hecla.com/",
    "HYMC": "https://hycroftmining.com/",
    "IAG": "https://www.iamgold.com/",
    "KGC": "https://www.kinross.com/",
    "LAC": "https://www.lithiumamericas.com/",
    "LAR": "https://www.lithium-argentina.com/",
    "LUC": "https://lucaradiamond.com/",
    "MO": "https://themacoresource.com/",
    "MP": "https://mpmaterials.com/",
    "MUX": "https://www.mcewenmining.com/",
    "NEM": "https://www.newmont.com/",
    "NG": "https://www.novagold.com/",
    "PAAS": "https://www.panamericansilver.com/",
    "PZG": "https://paramountnevada.com/",
    "RIO": "https://www.riotinto.com/",
    "SBSW": "https://www.sibanyestillwater.com/",
    "SCCO": "https://southerncoppercorp.com/",
    "SKE": "https://skeenaresources.com/",
    "SSRM": "https://www.ssrmining.com/",
    "TMQ": "https://trilogymetals.com/",
    "UEC": "https://www.uraniumenergy.com/",
    "UUUU": "https://www.energyfuels.com/",
    "WPM": "https://www.wheatonpm.com/",
}

PORTFOLIO_HOMEPAGES = {
    "AG": "https://www.firstmajestic.com/",
    "ARIS": "https://aris-mining.com/",
    "CDE": "https://www.coeur.com/",
    "FNV": "https://www.franco-nevada.com/",
    "GFI": "https://www.goldfields.com/",
    "GOLD": "https://www.barrick.com/",
    "HYMC": "https://hycroftmining.com/",
    "IAUX": "https://www.i80gold.com/",
    "MAG": "https://magsilver.com/",
    "PZG": "https://paramountnevada.com/",
    "WPM": "https://www.wheatonpm.com/",
}

KNOWN_PROJECT_PATHS = {
    "GFI": ["/australia-operations.php", "/canada-operations.php", "/chile-operations.php",
            "/ghana-operations.php", "/peru-operations.php", "/south-africa-operations.php"],
    "HYMC": ["/hycroft-mine/overview/"],
    "IAUX": ["/granite-creek-underground/", "/ruby-hill-complex-archimedes-underground/", "/cove-2/",
             "/granite-creek/", "/ruby-hill/", "/lone-tree/", "/fad-project/"],
    "PZG": ["/PageBuilder/Grassy-Mountain-Gold", "/PageBuilder/Sleeper-Gold-Project",
            "/PageBuilder/Bald-Peak", "/PageBuilder/Non-core-Assets"],
    "THM": ["/projects/livengold-gold-project/", "/projects/livengood-gold-project/"],
    "VGZ": ["/mt-todd/"],
    "VZLA": ["/panuco-project/"],
}

KNOWN_LANDING_PATHS = {
    "AG": ["/operations/"],
    "ARIS": ["/operations/"],
    "AUGO": ["/en/operations/", "/operacoes/"],
    "CDE": ["/operations/default.aspx"],
    "DRD": ["/our-business/"],
    "EQX": ["/operations/"],
    "FNV": ["/assets/portfolio/", "/our-assets/"],
    "GFI": ["/where-we-operate/"],
    "GOLD": ["/English/operations/default.aspx"],
    "HL": ["/operations/"],
    "HMY": ["/where-we-operate/", "/operations/"],
    "WPM": ["/portfolio/portfolio-overview/default.aspx"],
}

COMMON_LANDING_PATHS = [
    "/operations/", "/operations/default.aspx", "/portfolio/", "/portfolio/default.aspx", "/projects/",
    "/projects/default.aspx", "/assets/", "/assets/default.aspx", "/properties/", "/mines/", "/exploration/",
    "/development-projects/", "/our-assets/", "/our-business/", "/where-we-operate/",
]

LINK_TERMS = [
    "asset", "assets", "deposit", "development", "exploration", "gold", "mine", "mines", "operation",
    "operations", "portfolio", "project", "projects", "properties", "property", "silver",
]
NEGATIVE_TERMS = [
    "about", "careers", "contact", "cookie", "disclaimer", "governance", "investor", "media", "news",
    "privacy", "sedar", "sec-filings", "subscribe", "sustainability",
]
BINARY_SUFFIX = r"\.(jpg|jpeg|png|gif|webp|zip|docx?|xlsx?)($|\?)"
ANCHOR_WORDS = ["gold", "silver", "copper", "mine", "project", "property", "operation", "deposit"]
BLOCK_WORDS = ["project", "property", "portfolio", "asset", "operation", "mine", "card"]
NAME_NOUNS = ["mine", "project", "property", "deposit", "operation", "complex", "district", "stream", "royalty"]
SECTION_WORDS = ["overview", "operations", "portfolio", "projects", "properties", "assets"]
GENERIC_NAMES = ["overview", "operations", "projects", "properties", "portfolio", "assets", "our assets",
                 "where we operate"]
GENERIC_WORDS = ["404", "error", "not found", "privacy", "contact", "news", "investors", "home"]
STATUS_WORDS = ["production", "producing", "operating", "development", "exploration", "advanced exploration",
                "permitting", "feasibility", "construction"]
STYLE_WORDS = ["open pit", "underground", "heap leach", "milling", "processing", "placer", "surface mine",
               "bulk underground"]
RESOURCE_WORDS = ["measured and indicated", "M&I", "indicated", "inferred"]
GEOLOGY_WORDS = ["geology", "geological", "mineralization", "mineralisation", "deposit", "vein", "orebody", "hosted"]
REPORT_WORDS = ["NI 43-101", "SK-1300", "technical report", "feasibility study", "PEA",
                "preliminary economic assessment"]
REPORT_URL_WORDS = ["pdf", "technical", "report", "43-101", "sk-1300", "feasibility", "pea"]
EVIDENCE_WORDS = ["resource", "reserve", "geology", "ownership", "technical report"]
PLACES = [
    "Nevada", "Ontario", "Quebec", "British Columbia", "Mexico", "Peru", "Chile", "Ghana", "South Africa",
    "Australia", "Brazil", "Argentina", "Colombia", "United States", "Canada", "Idaho", "Alaska", "Arizona",
    "California", "Colorado", "Montana", "New Mexico", "Oregon", "Utah", "Washington", "Wyoming",
]
FAILED_CONCLUSIONS = ["failure", "timed_out", "cancelled", "action_required"]
CRITICAL_CONCLUSIONS = ["failure", "timed_out", "action_required"]

# ---------------------------------------------------------------------------
# The same values as tables. All of them are short literals of fixed length.
# ---------------------------------------------------------------------------


def workflows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        WORKFLOWS, "name string, file string, category string, threshold_hours double, feeds string")


def table_checks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        TABLE_CHECKS, "table string, category string, latest_column string, threshold_hours double, label string")


def channels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHANNELS, "name string, query string, handle_url string")


def keyword_tags(spark: SparkSession) -> DataFrame:
    rows = [(i, word, symbols) for i, (word, symbols) in enumerate(KEYWORD_TAGS)]
    return spark.createDataFrame(rows, "pos int, keyword string, symbols array<string>")


def curated_homepages(spark: SparkSession, portfolio: bool = False) -> DataFrame:
    pairs = PORTFOLIO_HOMEPAGES if portfolio else CURATED_HOMEPAGES
    return spark.createDataFrame(list(pairs.items()), "symbol string, url string")


def _paths(spark: SparkSession, by_symbol: dict[str, list[str]]) -> DataFrame:
    rows = [(symbol, i, p) for symbol, paths in by_symbol.items() for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, "symbol string, pos int, path string")


def known_project_paths(spark: SparkSession) -> DataFrame:
    return _paths(spark, KNOWN_PROJECT_PATHS)


def known_landing_paths(spark: SparkSession) -> DataFrame:
    return _paths(spark, KNOWN_LANDING_PATHS)


def common_landing_paths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(COMMON_LANDING_PATHS)), "pos int, path string")


def terms(spark: SparkSession, values: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), "pos int, term string")
