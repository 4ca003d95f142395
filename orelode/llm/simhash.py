"""SimHash near-duplicates by anchor points of a covering code.

The anchors are the words of the perfect Hamming code of length 31: every point lies
within 1 bit of exactly one of them. Two fingerprints at most 2 bits apart are at most
1 bit apart in one of their two halves. So in each half a fingerprint has its home at
its only anchor within 1 bit (the covering radius), and visits every anchor within 2
bits (radius plus threshold): the partner of a linked pair always visits its home.
Residents and visitors of an anchor are compared; whole fingerprints decide.

A hot anchor, with more than ``CROWD`` residents, is compared another way, just as
exactly: points at most 2 bits apart have a point in common within 1 bit, so every
fingerprint around a hot anchor goes to the 65 points within 1 bit of it, and all that
meet at a point (65 at most, by geometry) are tied to the smallest. No step makes the
pairs of a group, and exact copies are one fingerprint throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from orelode.llm.graph import star_forest
from orelode.llm.shared import settle, spread

SHINGLE = 3
SEED = 42
THRESHOLD = 2
CODE_BITS = 31
#: Residents above which an anchor is hot; decides how pairs are found, never which.
CROWD = 64


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The hashes of all shingles of ``width`` words of a text, repeats included; fewer words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width \
        else [b" ".join(words)]
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the 3-word shingles of a text, repeats included; no words: 0."""
    return print_of(shingle_hashes(text, SHINGLE))


def print_of(hashes: np.ndarray) -> int:
    """64-bit SimHash of shingles given by their hashes, repeats included; none: 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):  # bounds the memory of very long texts
        part = hashes[at:at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array(np.array([fingerprint(x.as_py()) for x in batch], np.uint64).view(np.int64), pa.int64())


def fingerprint_of(text: Column) -> Column:
    """The fingerprint as a signed 64-bit column."""
    return F.arrow_udf(_fingerprints, "long")(text)


def _syndrome(point: Column) -> Column:
    """Where a 31-bit point differs from its anchor: bit number from 1, 0 if it is the anchor."""
    checks = [sum(1 << j for j in range(CODE_BITS) if (j + 1) >> b & 1) for b in range(5)]
    bits = [(F.bit_count(point.bitwiseAND(F.lit(mask).cast("long"))) % 2) * (1 << b) for b, mask in enumerate(checks)]
    return sum(bits[1:], bits[0])


def _flips(limit: int) -> Column:
    """By syndrome: the flips of up to ``limit`` bits that lead from a point to an anchor."""
    table = []
    for s in range(CODE_BITS + 1):
        flips = [1 << (s - 1)] if s else [0]
        if s and limit > 1:
            flips += [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, CODE_BITS + 1) if 0 < i < i ^ s]
        table.append(F.array(*(F.lit(x).cast("long") for x in flips)))
    return F.array(*table)


def _at_anchors(prints: DataFrame, limit: int) -> DataFrame:
    """(anchor, fp): the anchors within ``limit`` bits, in both halves; the half is the anchor's bit 31."""
    low = (1 << CODE_BITS) - 1
    halves = F.array(
        F.struct(F.lit(0).cast("long").alias("side"), F.col("fp").bitwiseAND(low).alias("point")),
        F.struct(F.lit(1 << CODE_BITS).alias("side"),
                 F.shiftrightunsigned("fp", 32).bitwiseAND(low).alias("point")))
    points = prints.select("fp", F.explode(halves).alias("half")).select(
        "fp", "half.side", "half.point", _syndrome(F.col("half.point")).alias("s"))
    return points.select("fp", F.explode(F.element_at(_flips(limit), F.col("s") + 1)).alias("flip"), "side", "point") \
        .select(F.col("point").bitwiseXOR(F.col("flip")).bitwiseOR(F.col("side")).alias("anchor"), "fp")


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b) so that fingerprints at most ``THRESHOLD`` bits apart are connected: ``prints`` has distinct ``fp``.

    Around anchors with at most ``crowd`` residents every pair is a link of its own; around
    hot ones links may run through the smallest of those that share a point. A fingerprint has 32 visits and 65 points,
    of which Spark's size of the table knows nothing, so neither is ever broadcast.
    """
    homes = _at_anchors(prints, 1)
    visits = _at_anchors(prints, 2)
    hot = settle(homes.groupBy("anchor").count().where(F.col("count") > crowd).select("anchor"), "anchors")
    pairs = homes.join(hot, "anchor", "left_anti").select("anchor", F.col("fp").alias("a")).join(
        spread(visits.select("anchor", F.col("fp").alias("b"))), "anchor").where(
        (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD))
    around = visits.join(hot, "anchor", "left_semi").select("fp").distinct()
    ball = F.array(F.lit(0).cast("long"), *(F.expr(f"shiftleft(1L, {i})") for i in range(64)))
    points = around.select("fp", F.explode(ball).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    smallest = points.groupBy(F.col("point").alias("p")).agg(F.min("fp").alias("b"), F.count("*").alias("n"))
    stars = points.join(spread(smallest.where("n > 1")), F.col("point") == F.col("p")).where("fp <> b")
    return pairs.select("a", "b").union(stars.select(F.col("fp").alias("a"), "b"))


def components(rows: DataFrame) -> DataFrame:
    """(fp, component_id, root) of each distinct fingerprint of ``rows`` (doc_id, fp), as a written table.

    Written, so that a join with it has nothing but its own shuffle on this side, and Spark
    can split the rows of a fingerprint that a large part of all documents share.
    """
    prints = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    forest = star_forest(links(prints.select("fp")))
    linked = forest.select(F.col("u").alias("fp"), F.col("v").alias("root")).union(
        forest.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    linked = linked.join(prints, "fp")
    lowest = linked.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("lowest"))
    linked = linked.join(lowest, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "root", "lowest")
    named = prints.join(linked, F.col("fp") == F.col("f"), "left").select(
        "fp", F.coalesce("lowest", "first").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return settle(named, "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate class of every row: the id, ``fingerprint`` (16 hex digits), ``component_id``.

    Documents whose fingerprints differ in at most 2 bits are linked; the class id is the
    smallest doc_id reachable. A null or empty text has fingerprint zero and is linked like
    any other. A row without id gets the class of its fingerprint, null if no member has
    an id. Repeated rows stay. Other columns are not read.
    """
    rows = settle(docs.select(F.col(id_col).alias("doc_id"), fingerprint_of(F.col(text_col)).alias("fp")), "prints")
    named = rows.join(components(rows), "fp")
    return named.select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but for near-duplicates: of each class, one row with its smallest id.

    Of rows that tie (the same id, or none in the whole class) the one with the smallest
    fingerprint and then hash of text stays. All columns are kept; working columns have
    names that begin with two underscores. Only ids, fingerprints and hashes are grouped;
    texts move once, by a key that no two classes share.
    """
    key = ["__none", "__id", "__fp", "__hash"]
    whole = docs.withColumns({
        "__none": F.col(id_col).isNull(), "__id": F.coalesce(F.col(id_col), F.lit(0)),
        "__fp": fingerprint_of(F.col(text_col)), "__hash": F.xxhash64(F.col(text_col))})
    rows = settle(whole.select(*key, F.col(id_col).alias("doc_id"), F.col("__fp").alias("fp")), "prints")
    classes = components(rows.select("doc_id", "fp")).select("fp", "root")
    kept = rows.join(classes, "fp").groupBy("root").agg(F.min(F.struct(*key)).alias("key"))
    kept = settle(kept.select(*(F.col(f"key.{c}").alias(c) for c in key)), "kept")
    return once_per(whole.join(kept, key, "left_semi"), key).select(*docs.columns)


def once_per(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key; equal rows are told apart only by their place."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*key))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")
