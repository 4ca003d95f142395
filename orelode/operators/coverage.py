"""Company-homepage coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.functions.keys import filled
from orelode.functions.times import moment
from orelode.functions.urls import domain, normalize_homepage
from orelode.operators.ranking import first_rows


def select_symbols(df: DataFrame, symbols: list[str] | DataFrame) -> DataFrame:
    """Rows of the listed symbols, blanks and case of the list aside; a long list is a table with a column ``symbol``."""
    if isinstance(symbols, DataFrame):
        named = F.upper(F.regexp_replace("symbol", r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", ""))
        return df.join(symbols.select(named.alias("symbol")).distinct(), "symbol", "left_semi")
    return df.filter(F.col("symbol").isin([s.strip().upper() for s in symbols]))


def requested_symbols(universe: DataFrame, requested: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """All symbols in code-point order, or the requested ones in their order; at most ``limit``.

    ``requested`` has ``symbol`` and ``pos``; its duplicates stay.
    """
    if requested is None:
        return first_rows(universe.select("symbol"), [F.col("symbol")], limit) if limit else universe.select("symbol")
    named = requested.select(F.upper("symbol").alias("symbol"), "pos")
    return (first_rows(named, [F.col("pos")], limit) if limit else named).select("symbol")


def homepage_rows(requests: DataFrame, universe: DataFrame, curated: DataFrame, generated_at,
                  map_label: str = "curated_homepage_map", universe_label: str = "company_universe",
                  snippet: str = "Curated homepage URL.") -> DataFrame:
    """One row per requested symbol: found, not found, or not in the universe."""
    known = universe.select("symbol", "name", "metal", "company_type", F.lit(True).alias("known"))
    joined = requests.join(known, "symbol", "left").join(curated.select("symbol", "url"), "symbol", "left")
    has_url = F.col("known").isNotNull() & F.nullif(F.col("url"), F.lit("")).isNotNull()
    rows = joined.select(
        "*", has_url.alias("has_url"),
        F.when(F.col("known").isNotNull(), filled(F.col("name"), F.col("symbol"))).alias("title_name"),
        F.when(has_url, normalize_homepage(F.col("url"))).alias("homepage_url"),
    )
    in_universe = F.col("known").isNotNull()

    def found(yes: str, no: str | None):
        return F.when(in_universe & F.col("has_url"), F.lit(yes)).when(in_universe, F.lit(no).cast("string"))

    return rows.select(
        "symbol",
        F.col("title_name").alias("company_name"),
        F.col("title_name").alias("name"),
        F.col("title_name").alias("short_name"),
        F.when(in_universe, filled(F.col("metal"), F.lit("unknown"))).alias("metal"),
        F.nullif(F.col("company_type"), F.lit("")).alias("company_type"),
        "homepage_url",
        domain(F.col("homepage_url")).alias("matched_domain"),
        domain(F.col("homepage_url")).alias("homepage_domain"),
        F.when(F.col("has_url"), F.lit(0.98)).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(~in_universe, F.lit("not_in_universe")).when(F.col("has_url"), F.lit("found"))
        .otherwise(F.lit("not_found")).alias("status"),
        found("curated", "missing_curated_url").alias("match_method"),
        found(map_label, universe_label).alias("source"),
        F.when(F.col("has_url"), F.concat(F.col("title_name"), F.lit(" official homepage"))).alias("source_title"),
        found(snippet, None).alias("source_snippet"),
        F.concat(F.col("title_name"), F.lit(" official homepage")).alias("search_query"),
        F.when(in_universe, F.lit(map_label)).alias("search_provider"),
        F.when(in_universe & ~F.col("has_url"), F.lit("No curated homepage URL available.")).alias("error_message"),
        F.when(in_universe, moment(generated_at)).alias("checked_at"),
        moment(generated_at).alias("generated_at"),
    )


def coverage(rows: DataFrame) -> DataFrame:
    found = F.count_if(F.col("status") == "found")
    return rows.agg(F.count(F.lit(1)).alias("total"), found.alias("found"), (F.count(F.lit(1)) - found).alias("missing"))


def coverage_by(rows: DataFrame, *columns: str) -> DataFrame:
    found = F.count_if(F.col("status") == "found")
    return rows.groupBy(*columns).agg(
        F.count(F.lit(1)).alias("total"), found.alias("found"), (F.count(F.lit(1)) - found).alias("missing"))


def found_homepages(rows: DataFrame, arrival: str | None = None) -> DataFrame:
    """Symbol and URL of found homepages; of several rows of a symbol the last wins."""
    usable = rows.filter(
        (F.col("status") == "found") & F.nullif(F.col("symbol"), F.lit("")).isNotNull()
        & F.nullif(F.col("homepage_url"), F.lit("")).isNotNull()
    ).withColumn("symbol", F.upper("symbol"))
    place = F.col(arrival) if arrival else F.col("homepage_url")
    return usable.groupBy("symbol").agg(F.max_by("homepage_url", place).alias("url"))


def resolve_homepages(companies: DataFrame, curated: DataFrame, discovered: DataFrame) -> DataFrame:
    """Companies with their homepage, curated before discovered; empty counts as missing."""
    return (
        companies.join(curated.select("symbol", F.col("url").alias("curated_url")), "symbol", "left")
        .join(discovered.select("symbol", F.col("url").alias("found_url")), "symbol", "left")
        .withColumn("homepage_url", filled(F.col("curated_url"), F.col("found_url")))
        .drop("curated_url", "found_url")
    )
