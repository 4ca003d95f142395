"""Media mentions, sentiment trends, symbol normalisation and entity lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def phrases(symbols: DataFrame) -> DataFrame:
    """Match phrases of each symbol (``symbol, aliases, context``).

    Rows are ``symbol, first_word, phrase, phrase_text, is_alias, needs_context``, the
    phrase as its words and as text. The ticker is an alias too; a symbol without context words needs none.
    """

    def listed(c: str) -> Column:
        return F.coalesce(F.col(c), F.array().cast("array<string>"))

    def phrase(c: Column, is_alias: bool) -> Column:
        return F.transform(F.array_distinct(F.transform(c, tokens)), lambda p: F.struct(
            p.alias("phrase"), F.lit(is_alias).alias("is_alias")))

    every = F.concat(phrase(F.concat(F.array("symbol"), listed("aliases")), True), phrase(listed("context"), False))
    rows = symbols.select("symbol", (F.size(listed("context")) > 0).alias("needs_context"), F.inline(every))
    return rows.filter(F.size("phrase") > 0).withColumn("first_word", F.col("phrase")[0]).withColumn(
        "phrase_text", F.array_join("phrase", " "))


def mentions(docs: DataFrame, phrase_table: DataFrame) -> DataFrame:
    """One row per document and symbol it mentions, with the number of occurrences.

    An alias must occur as a whole run of words, and a context word anywhere in
    the text. Each word carries as many words after it as the
    longest phrase has and meets the distinct phrases by an equi-join on the first word;
    hits are counted per document and phrase before anything is shuffled, and only then
    spread over the symbols that share the phrase.
    """
    # the outer form, as the plain one makes the optimizer tokenise once more in a
    # filter for empty texts; their one NULL word joins nothing
    words = docs.select("doc_id", tokens(F.col("text")).alias("w")).select(
        "doc_id", "w", F.posexplode_outer("w").alias("pos", "first_word"))
    longest = phrase_table.agg(F.coalesce(F.max(F.size("phrase")), F.lit(0))).scalar()
    runs = words.select("doc_id", "first_word", F.slice("w", F.col("pos") + 1, longest).alias("run"))
    distinct = phrase_table.select("first_word", "phrase", "phrase_text").dropDuplicates(["phrase_text"])
    hits = runs.join(distinct, "first_word").filter(
        F.slice("run", F.lit(1), F.size("phrase")) == F.col("phrase")
    ).groupBy("doc_id", "phrase_text").agg(F.count(F.lit(1)).alias("n"))
    spread_out = hits.join(phrase_table.select("symbol", "phrase_text", "is_alias", "needs_context"), "phrase_text")
    per_doc = spread_out.groupBy("doc_id", "symbol", "needs_context").agg(
        F.sum(F.when(F.col("is_alias"), F.col("n"))).alias("occurrences"),
        F.max(~F.col("is_alias")).alias("in_context"))
    return per_doc.filter(
        (F.col("occurrences") > 0) & (~F.col("needs_context") | F.col("in_context"))
    ).select("doc_id", "symbol", "occurrences")


def mention_counts(found: DataFrame, *axes: str) -> DataFrame:
    """Documents and weight per symbol, and per further axes such as a time window."""
    return found.groupBy("symbol", *axes).agg(
        F.count(F.lit(1)).alias("mentions"), F.round(F.sum(1 + F.log10("occurrences")), 6).alias("weight"))


def first_copies(docs: DataFrame) -> DataFrame:
    """Lowest id of each text, so that a news item carried many times counts once.

    Only ids leave here: keep mentions of these documents by a semi-join, which
    moves short rows and never the texts. Copies collapse in the map tasks.
    """
    digest = F.sha2(F.regexp_replace(F.trim(F.lower("text")), r"\s+", " "), 256)
    return docs.select("doc_id", digest.alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


def sentiment_score(label: Column) -> Column:
    return F.when(label == "positive", F.lit(1)).when(label == "negative", F.lit(-1)).when(label == "neutral", F.lit(0))


def sentiment_trend(scored: DataFrame, axes: Sequence[str], step: float = 0.1) -> DataFrame:
    """Mean score per axis value and period, and its trend against the period before.

    ``scored`` has ``period``, ``score`` and the axis columns; one grouping-sets
    pass serves all axes, and the overall mean is the axis named ``all``.
    """
    columns = [F.col(a) for a in axes]
    sets = [[F.col("period"), c] for c in columns] + [[F.col("period")]]
    mean = scored.groupingSets(sets, "period", *axes).agg(
        F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    # the bit of a column in the grouping id is set where the column is not grouped
    whole = 2 ** len(axes) - 1
    axis, value = F.lit("all"), F.lit("all")
    for i, a in enumerate(axes):
        gid = whole - 2 ** (len(axes) - 1 - i)
        axis = F.when(F.col("gid") == gid, F.lit(a)).otherwise(axis)
        value = F.when(F.col("gid") == gid, F.col(a).cast("string")).otherwise(value)
    w = Window.partitionBy("axis", "value").orderBy("period")
    rows = mean.select(axis.alias("axis"), value.alias("value"), "period",
                       F.round("mean_score", 6).alias("mean_score"), "n")
    rows = rows.withColumn("delta", F.round(F.col("mean_score") - F.lag("mean_score").over(w), 6))
    return rows.withColumn(
        "trend", F.when(F.col("delta") > step, F.lit("improving")).when(F.col("delta") < -step, F.lit("deteriorating"))
        .otherwise(F.lit("stable")))


def canonical_symbols(rows: DataFrame, listings: DataFrame, sector: DataFrame | None = None) -> DataFrame:
    """Listing symbols to the canonical one; ``sector`` keeps only symbols it lists."""
    named = rows.withColumn("listing", F.upper(F.trim("symbol"))).drop("symbol").join(
        listings.select(F.upper("alias").alias("listing"), "canonical"), "listing", "left"
    ).withColumn("symbol", F.coalesce("canonical", "listing")).drop("canonical")
    return named.join(sector.select("symbol"), "symbol", "left_semi") if sector is not None else named


def entity_lookup(companies: DataFrame, q: str) -> DataFrame:
    """Companies whose symbol is the query or whose name contains it."""
    term = q.strip().lower()
    return companies.filter((F.lower("symbol") == term) | F.lower("name").contains(term))
