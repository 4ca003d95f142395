"""Near copies by the Jaccard similarity of word shingles: SimHash and banded min-hash for candidates, an exact check for links.

Texts whose sets of shingles are at least ``LEAST`` alike are linked, and a class is what is
linked directly or through others. Candidates are texts whose SimHash fingerprints (of all shingles, repeats included) differ in
at most 2 bits, met at the anchors of ``orelode.llm.simhash``. Texts that are 0.8 alike differ in some 10 bits, so
candidates are those too that share one of ``BANDS`` buckets, each a hash of
``ROWS`` min-hash values; two texts that are just 0.8 alike share none with a probability of
(1 - 0.8^4)^32 = 5e-8. Of each min-hash value two bits are kept: of sets that are 0.8 alike 26 of the
256 bits differ, give or take 6, so candidates with more than ``APART`` differing bits are left out (a loss of
2e-9). Without any loss those are left out that cannot have enough in common by ``near.marks``: shingles that no other set holds
never are, and the parities of the others bound how many differ. So copies that were each changed on their own, and are nearly
but not quite ``LEAST`` alike, are not compared pair by pair. All others are
decided on the sorted hashes of their shingles, which are kept once for each set.

Texts with the same set are one node. First every set meets the middle of each of its buckets, the member that
shares most buckets with others. What
then is in one class already is never compared again: ``ROUNDS`` times the ``CROWD`` largest classes of a bucket send one
member each to meet all members of other classes, and at last every member outside the largest class of its
bucket meets all of other classes. A round without a new link is followed by the last one. So a large group of near copies is joined without making its pairs, and no
candidate is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from orelode.llm.graph import star_forest
from orelode.llm.shared import settle, spread, temporary
from orelode.llm.simhash import SEED, links, once_per, print_of, shingle_hashes
from orelode.operators.near import marks, shares_enough

SHINGLE = 5
LEAST = 0.8
BANDS = 32
ROWS = 4
#: Rounds of single members, and classes of a bucket that send one; decide how links are found, never which.
ROUNDS = 3
CROWD = 4
#: Differing bits of two signatures beyond which sets are not compared.
APART = 60
#: Shingles handled at once; bounds the memory of very long texts.
AT_ONCE = 4096

_DRAW = np.random.default_rng(SEED)
_FLIP = _DRAW.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_FACTOR = _DRAW.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_BAND = _DRAW.integers(0, 1 << 63, (2, BANDS), np.uint64) | np.uint64(1)

SIGNATURE = ["s0", "s1", "s2", "s3"]
#: Columns of parities, which members of buckets carry through all rounds.
MARKS = ["m0", "m1", "m2", "m3"]
#: What a member of a bucket is judged by before it is compared.
TRAITS = ["set", "size", *SIGNATURE, "core", *MARKS]
SKETCH = f"struct<set:long,fp:long,size:int,buckets:array<long>,{','.join(f'{c}:long' for c in SIGNATURE)}>"


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; fewer words than a shingle are one, none are none."""
    return np.unique(shingle_hashes(text, width))


def lowest_of(shingles: np.ndarray) -> np.ndarray:
    """The min-hash values of a set of shingles."""
    lowest = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    folded = (shingles ^ shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(folded), AT_ONCE):
        np.minimum(lowest, ((folded[at:at + AT_ONCE] ^ _FLIP) * _FACTOR).min(axis=1), out=lowest)
    return lowest


def buckets_of(lowest: np.ndarray) -> np.ndarray:
    """The bucket in each band."""
    pairs = lowest.reshape(BANDS, ROWS).view("<u8")
    mixed = pairs[:, 0] * _BAND[0] + (pairs[:, 1] ^ pairs[:, 1] >> np.uint64(31)) * _BAND[1]
    return mixed ^ mixed >> np.uint64(29)


def signature_of(lowest: np.ndarray) -> np.ndarray:
    """Two bits of each value, as numbers of 64 bits."""
    mixed = lowest * np.uint32(0x9E3779B1)
    return np.packbits(np.concatenate([mixed >> np.uint32(13) & np.uint32(1), mixed >> np.uint32(22) & np.uint32(1)])).view("<u8")


def sketch_of(text: Column, width: int) -> Column:
    """``SKETCH``: a hash of the set of shingles (0: no words), the fingerprint, the set's size, its buckets, its signature."""

    def sketches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            shingles = [shingle_hashes(x.as_py(), width) for x in batch]
            sets = [np.unique(x) for x in shingles]
            lowest = [lowest_of(x) for x in sets]
            marks = np.array([signature_of(x) for x in lowest], np.uint64).reshape(-1, len(SIGNATURE)).view(np.int64)
            yield pa.StructArray.from_arrays([
                pa.array(np.array([xxh64_intdigest(x.tobytes(), SEED) if len(x) else 0 for x in sets], np.uint64).view(
                    np.int64), pa.int64()),
                pa.array(np.array([print_of(x) for x in shingles], np.uint64).view(np.int64), pa.int64()),
                pa.array([len(x) for x in sets], pa.int32()),
                pa.array([buckets_of(y).view(np.int64) if len(x) else [] for x, y in zip(sets, lowest, strict=True)],
                         pa.list_(pa.int64())),
                *(pa.array(np.ascontiguousarray(marks[:, k])) for k in range(len(SIGNATURE))),
            ], ["set", "fp", "size", "buckets", *SIGNATURE])

    return F.arrow_udf(sketches, SKETCH)(text)


def hashes_of(text: Column, width: int) -> Column:
    """The sorted hashes of a text's shingles, 8 bytes each."""

    def hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shingle_set(x.as_py(), width).tobytes() for x in batch], pa.binary())

    return F.arrow_udf(hashes, "binary")(text)


def longs_of(hashes: Column) -> Column:
    """The hashes of ``hashes_of`` as numbers."""

    def numbers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([np.frombuffer(x.as_buffer(), np.int64) for x in batch], pa.list_(pa.int64()))

    return F.arrow_udf(numbers, "array<long>")(hashes)


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets, given by their sorted hashes."""

    def shares(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right, strict=True):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                out.append(both / max(1, len(p) + len(q) - both))
            yield pa.array(out, pa.float64())

    return F.arrow_udf(shares, "double")(a, b)


def _may_be_alike(least: float) -> Column:
    """Whether a pair of members, one with columns named ``a_``, can be ``least`` alike by size, signature and marks."""
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"a_{c}"))) for c in SIGNATURE[1:]),
                F.bit_count(F.col(SIGNATURE[0]).bitwiseXOR(F.col(f"a_{SIGNATURE[0]}"))))
    return (F.least("size", "a_size") >= least * F.greatest("size", "a_size")) & (apart <= APART) & shares_enough(least, MARKS)


def _links(pairs: DataFrame, shelf: DataFrame, forest: DataFrame | None, least: float) -> DataFrame:
    """The forest (u, v) with those candidate pairs (u, v) that are ``least`` alike; ``forest`` itself if there are none."""
    with temporary(pairs.sparkSession) as block:
        held = settle(pairs.distinct(), "pairs")
        if forest and held.isEmpty():
            return forest
        left, right = (shelf.select(F.col("set").alias(k), F.col("hashes").alias(f"{k}_hashes")) for k in "uv")
        both = held.join(left, "u").join(right, "v")
        found = settle(both.where(similarity(F.col("u_hashes"), F.col("v_hashes")) >= least).select("u", "v"), "found")
        if forest and found.isEmpty():
            return forest
        return block.result(star_forest(forest.union(found) if forest else found), "forest")


def _mixed(members: DataFrame, forest: DataFrame, rows: int | None = None) -> DataFrame:
    """Of ``members``, at most ``rows``, those of the buckets that have more than one class, with their class ``root`` and the largest class ``top`` of the bucket."""
    roots = forest.select(F.col("u").alias("set"), F.col("v").alias("other"))
    named = members.join(roots, "set", "left").withColumn("root", F.coalesce("other", "set")).drop("other")
    classes = named.groupBy("bucket", "root").agg(F.count("*").alias("own"))
    largest = classes.groupBy("bucket").agg(F.max(F.struct("own", "root")).alias("top"), F.count("*").alias("classes"))
    return named.join(spread(largest.where("classes > 1").select("bucket", F.col("top.root").alias("top")), rows), "bucket")


def _some(named: DataFrame, crowd: int) -> DataFrame:
    """Of each of the ``crowd`` largest classes of a bucket the member that shares most buckets with others."""
    classes = named.groupBy("bucket", "root").agg(
        F.count("*").alias("own"), F.max(F.struct("known", *TRAITS)).alias("first"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("own"), "root"))
    return classes.withColumn("place", place).where(F.col("place") <= crowd).select("bucket", "root", "first.*")


def _met(named: DataFrame, probes: DataFrame, each_once: Column, least: float, rows: int | None = None) -> DataFrame:
    """Candidate pairs (u, v): members, at most ``rows``, with the probes of their bucket that are of other classes."""
    a = probes.select("bucket", *(F.col(c).alias(f"a_{c}") for c in ("root", *TRAITS)))
    pairs = named.join(spread(a, rows), "bucket").where((F.col("root") != F.col("a_root")) & each_once & _may_be_alike(least))
    return pairs.select(F.greatest("set", "a_set").alias("u"), F.least("set", "a_set").alias("v"))


def by_prints(sketches: DataFrame) -> DataFrame:
    """Candidate pairs (u, v) of sets whose fingerprints differ in at most 2 bits, as stars around the smallest set of a fingerprint."""
    held = settle(sketches.where("size > 0").select("fp", "set").distinct(), "prints")
    lowest = settle(held.groupBy("fp").agg(F.min("set").alias("low")), "fingerprints")
    same = held.join(lowest, "fp").where("set <> low").select(F.col("set").alias("x"), F.col("low").alias("y"))
    a, b = (lowest.select(F.col("fp").alias(k), F.col("low").alias(n)) for k, n in (("a", "x"), ("b", "y")))
    near = links(lowest.select("fp")).distinct().join(a, "a").join(b, "b").where("x <> y").select("x", "y")
    return same.union(near).select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))


def forest_of(sketches: DataFrame, shelf_of, least: float = LEAST, rounds: int = ROUNDS, crowd: int = CROWD) -> DataFrame:
    """(u, v) for every set u but the smallest of its class, v being that one.

    ``sketches`` has the columns of ``SKETCH``; ``shelf_of`` gives (set, hashes), one row for each
    set of a table of sets.
    """
    with temporary(sketches.sparkSession) as block:
        every = settle(sketches.select("set", F.explode("buckets").alias("bucket")).distinct(), "buckets")
        shared = every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        met = settle(every.join(shared, "bucket"), "shared")
        # the text that copies were made from shares more buckets with them than they share with one another
        prints = settle(by_prints(sketches).distinct(), "near")
        shelf = settle(shelf_of(met.select("set").union(prints.select("u")).union(prints.select("v")).distinct()), "shelf")
        own = met.groupBy("set").agg(F.sum("n").alias("known")).join(
            sketches.select("set", "size", *SIGNATURE).dropDuplicates(["set"]), "set").join(
            marks(shelf.select("set", F.explode(longs_of(F.col("hashes"))).alias("h")), MARKS), "set")
        # a set of which too little is anywhere else is linked with none
        own = own.where(F.col("core") >= least * F.col("size") - 1e-6)
        members = settle(met.drop("n").join(own, "set"), "members")
        middle = members.groupBy("bucket").agg(F.max(F.struct("known", *TRAITS)).alias("m")).select(
            "bucket", *(F.col(f"m.{c}").alias(f"a_{c}") for c in TRAITS))
        first = members.join(spread(middle), "bucket").where((F.col("set") != F.col("a_set")) & _may_be_alike(least))
        first = first.select(F.greatest("set", "a_set").alias("u"), F.least("set", "a_set").alias("v"))
        forest = _links(prints.union(first), shelf, None, least)
        many = None
        k, changed = 0, True
        while k <= rounds:
            if changed:
                members = settle(_mixed(members.drop("root", "top"), forest, many), "mixed")
                many = members.count()
                if not many:
                    break
            if k < rounds:
                pairs = _met(members, _some(members, crowd), F.lit(True), least, many)
            else:  # whoever is outside the largest class meets all of other classes
                once = (F.col("root") == F.col("top")) | (F.col("a_set") < F.col("set"))
                pairs = _met(members, members.where("root <> top"), once, least, many)
            after = _links(pairs, shelf, forest, least)
            changed, forest = after is not forest, after
            # single members that found no link would meet the same members again: the last round is next
            k = k + 1 if changed or k == rounds else rounds
        return block.result(forest, "forest")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                  least: float = LEAST, rounds: int = ROUNDS, crowd: int = CROWD) -> DataFrame:
    """The rows of ``docs`` but for near copies: of each class, one row with its smallest id.

    Texts without words, null or not, are one class. Of rows that tie (the same id, or none in
    the whole class) the one with the smallest hash of text stays. All columns are kept;
    working columns have names that begin with two underscores.
    """
    key = ["__none", "__id", "__hash"]
    whole = docs.withColumns({
        "__none": F.col(id_col).isNull(), "__id": F.coalesce(F.col(id_col), F.lit(0)),
        "__hash": F.xxhash64(F.col(text_col))})
    with temporary(docs.sparkSession) as block:
        rows = settle(whole.select(*key, sketch_of(F.col(text_col), width).alias("sketch")).select(*key, "sketch.*"), "sketches")
        # a smallest row for each set, counted in the map tasks: exact copies meet nothing but this
        firsts = settle(rows.groupBy("set").agg(F.min(F.struct(*key)).alias("key")), "firsts")

        def shelf_of(sets: DataFrame) -> DataFrame:
            owner = firsts.join(sets, "set", "left_semi").select(
                F.col("set").alias("__set"), *(F.col(f"key.{c}").alias(c) for c in key))
            held = whole.select(*key, F.col(text_col).alias("__text")).join(owner, key)
            return once_per(held.select(F.col("__set").alias("set"), hashes_of(F.col("__text"), width).alias("hashes")), ["set"])

        forest = forest_of(rows, shelf_of, least, rounds, crowd)
        root = forest.select(F.col("u").alias("set"), F.col("v").alias("other"))
        kept = firsts.join(root, "set", "left").groupBy(F.coalesce("other", "set").alias("root")).agg(F.min("key").alias("key"))
        kept = block.result(kept.select(*(F.col(f"key.{c}").alias(c) for c in key)), "kept")
    return once_per(whole.join(kept, key, "left_semi"), key).select(*docs.columns)
