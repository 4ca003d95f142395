"""Text preparation of news items before counting: boilerplate lines and noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequent_lines(docs: DataFrame, min_docs: int, min_share: float = 0.01, per_text: bool = True) -> DataFrame:
    """Lines, trimmed, of at least ``min_docs`` documents and more than ``min_share`` of all rows of ``docs``.

    Copies of a text count as one document, unless ``per_text`` is off; a share of 0 leaves the count alone to decide.
    Counted in the map tasks before the shuffle.
    """
    lines = _lines(docs, F.sha2("text", 256)) if per_text else _lines(docs)
    n = F.count_distinct("copy") if per_text else F.count(F.lit(1))
    found = lines.groupBy("line").agg(n.alias("n")).filter(F.col("n") >= min_docs)
    if min_share:
        found = found.filter(F.col("n") > min_share * docs.agg(F.count(F.lit(1))).scalar())
    return found.select("line")


def _lines(docs: DataFrame, copy: Column | None = None) -> DataFrame:
    every = F.array_distinct(F.transform(F.split("text", "\n"), F.trim))
    more = [] if copy is None else [copy.alias("copy")]
    return docs.select("doc_id", *more, F.explode(every).alias("line")).filter(F.col("line") != "")


def without_boilerplate(docs: DataFrame, min_docs: int, min_share: float = 0.01, per_text: bool = True) -> DataFrame:
    """``doc_id, text, dropped`` with the frequent lines taken out of each text; see ``frequent_lines``.

    A document meets only those frequent lines that it has, so what is gathered for it is
    no longer than its text. ``doc_id`` must be a key; a null text stays null.
    """
    hits = _lines(docs).join(frequent_lines(docs, min_docs, min_share, per_text), "line").groupBy("doc_id").agg(
        F.collect_set("line").alias("frequent"))
    joined = docs.select("doc_id", "text").join(hits, "doc_id", "left")
    frequent = F.coalesce("frequent", F.array().cast("array<string>"))
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(frequent, F.trim(x)))
    return joined.select("doc_id", F.array_join(kept, "\n").alias("text"),
                         (F.size(lines) - F.size(kept)).alias("dropped"))


def is_prose(text: Column, min_chars: int = 20, min_letters: float = 0.6) -> Column:
    """Long enough, and mostly letters; false for null."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.coalesce((F.length(text) >= min_chars) & (letters >= min_letters * F.length(text)), F.lit(False))
