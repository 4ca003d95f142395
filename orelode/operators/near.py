"""Near copies of texts: banded min-hash for candidates, an exact check, classes by pointer jumping.

All of it are JVM expressions. Texts with the same set of shingles are one node. Candidates share
one of ``BANDS`` buckets, each a hash of ``ROWS`` min-hash values: texts that are just 0.8 alike share none with a
probability of (1 - 0.8^3)^21 = 3e-7. A bucket is never compared with itself: its members first meet its middle, the one that
shares most buckets with others, then one member of each of its largest classes, and at last those outside the largest class meet the
members of other classes whose size and marks allow a link. So a large group of near copies costs as many
comparisons as it has members, and no candidate is left out. Hashes of shingles are kept for sets that share a bucket alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelode.functions.text import once
from orelode.session import settle, temporary

BANDS = 21
ROWS = 3
#: Parities of a set's hashes, 64 in a column.
MARKS = [f"m{k}" for k in range(8)]
#: What a member of a bucket is judged by before it is compared.
TRAITS = ["set", "size", "core", *MARKS]
#: Classes of a bucket that send one member each in a round, and rounds.
CROWD = 4
ROUNDS = 2


def shingles(text: Column, width: int = 5) -> Column:
    """The distinct shingles of a text as hashes: lower-case words, fewer than a shingle are one, none are none."""
    words = F.filter(F.split(F.lower(text), r"[\x09-\x0D ]+"), lambda w: w != "")
    return once(words, lambda w: F.when(F.size(w) > 0, F.array_sort(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1))),
        lambda i: F.xxhash64(F.slice(w, i, width)))))))


def buckets(hashes: Column) -> Column:
    """The bucket of a set of hashes in each band."""
    return F.array(*(F.xxhash64(F.lit(band), *(_lowest(hashes, band * ROWS + row) for row in range(ROWS))) for band in range(BANDS)))


def _sketch(hashes: Column) -> Column:
    return F.when(hashes.isNotNull(), F.struct(
        F.xxhash64(hashes).alias("set"), F.size(hashes).alias("size"), buckets(hashes).alias("buckets")))


def _lowest(hashes: Column, seed: int) -> Column:
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(F.lit(seed), h)))


def marks(hashes: DataFrame, names: list[str] = MARKS) -> DataFrame:
    """(set, core, m0, m1, ...): how many of a set's hashes other sets hold too, and the parities of their numbers in classes.

    ``hashes`` is distinct (set, h); ``names`` are of parities, 64 in each, a power of two. A hash that one set alone holds is never in common, so it is left out.
    """
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    word = F.shiftright("h", 6).bitwiseAND(len(names) - 1)
    odd = [F.coalesce(F.bit_xor(F.when(word == k, bit)), F.lit(0).cast("long")).alias(m) for k, m in enumerate(names)]
    every = hashes.groupBy("set").agg(F.count("*").alias("core"), *odd)
    alone = hashes.groupBy("h").agg(F.count("*").alias("n"), F.min("set").alias("set")).where("n = 1")
    less = alone.groupBy("set").agg((-F.count("*")).alias("core"), *odd)
    return every.union(less).groupBy("set").agg(F.sum("core").alias("core"), *(F.bit_xor(m).alias(m) for m in names))


def shares_enough(least: float, names: list[str] = MARKS) -> Column:
    """Whether a pair of sets, one with columns named ``a_``, can be ``least`` alike by size and ``marks``.

    Each class whose parities differ has a hash that only one of the two holds, so no link is left out.
    """
    apart = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"a_{m}"))) for m in names[1:]),
                F.bit_count(F.col(names[0]).bitwiseXOR(F.col(f"a_{names[0]}"))))
    both = F.col("core") + F.col("a_core") - apart  # twice what they have in common, at most
    return both * (1 + least) >= 2 * least * (F.col("size") + F.col("a_size")) - 1e-6


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``links`` (u, v) reaches, by pointer jumping.

    Each round a node takes the smallest root around it and then that root's own; rounds grow with the
    logarithm of the longest chain. Only tables of links and roots are written, and each replaces the one before.
    """
    spark = links.sparkSession
    both = settle(links.union(links.select("v", "u")).distinct(), "edges")
    roots = settle(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near")).select(
        "node", F.least("node", "near").alias("root")), "roots")
    while True:
        with temporary(spark) as block:
            own = roots.select(F.col("node").alias("v"), F.col("root").alias("near"))
            # the best root around each node, and around all nodes that share a root, hooks that root
            around = both.join(own, "v").groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"))
            hooked = roots.join(around, "node").select("node", "root", F.least("root", "near").alias("near"))
            best = hooked.groupBy(F.col("root").alias("hook")).agg(F.min("near").alias("best"))
            moved = settle(hooked.join(best, F.col("root") == F.col("hook")).select(
                "node", F.col("root").alias("old"), F.col("best").alias("root")), "moved")
            jump = moved.select(F.col("node").alias("at"), F.col("root").alias("further"))
            after = block.result(moved.join(jump, F.col("root") == F.col("at"), "left").select(
                "node", F.coalesce("further", "root").alias("root"), "old"), "roots")
        roots = after.select("node", "root")
        if after.where("root <> old").isEmpty():
            return roots


def _checked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of candidate pairs (u, v) those whose sets are ``least`` alike."""
    held = settle(pairs.distinct(), "pairs")
    left, right = (sets.select(F.col("set").alias(k), F.col("hashes").alias(f"{k}_hashes")) for k in "uv")
    common = F.size(F.array_intersect("u_hashes", "v_hashes"))
    union = F.size("u_hashes") + F.size("v_hashes") - common
    return held.join(left, "u").join(right, "v").where(common >= least * union).select("u", "v")


def _can_link(least: float) -> Column:
    """Whether sizes and marks of two members allow a link."""
    return (F.least("size", "a_size") >= least * F.greatest("size", "a_size") - 1e-6) & shares_enough(least)


def set_classes(sketches: DataFrame, shelf_of: Callable[[DataFrame], DataFrame], least: float = 0.8) -> DataFrame:
    """(set, root) for the sets of ``sketches`` (set, size, buckets; distinct) that are linked with another, ``root`` the smallest of the class.

    ``shelf_of`` gives (set, hashes), one row for each set of a table of sets; only sets that share a bucket are asked for.
    """
    spark = sketches.sparkSession
    with temporary(spark) as block:
        every = settle(sketches.select("set", "size", F.explode("buckets").alias("bucket")), "buckets")
        shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        met = settle(every.join(shared, "bucket"), "shared")
        sets = settle(shelf_of(met.select("set").distinct()), "shelf")
        # the text that copies were made from shares more buckets with them than they share with one another
        own = met.groupBy("set").agg(F.sum("n").alias("known"), F.first("size").alias("size")).join(
            marks(sets.select("set", F.explode("hashes").alias("h"))), "set")
        # a set of which too little is anywhere else is linked with none
        own = own.where(F.col("core") >= least * F.col("size") - 1e-6)
        members = settle(met.select("set", "bucket").join(own, "set"), "members")
        middle = members.groupBy("bucket").agg(F.max(F.struct("known", *TRAITS)).alias("m")).select(
            "bucket", *(F.col(f"m.{c}").alias(f"a_{c}") for c in TRAITS))
        first = members.join(middle, "bucket").where((F.col("set") != F.col("a_set")) & _can_link(least))
        first = first.select(F.greatest("set", "a_set").alias("u"), F.least("set", "a_set").alias("v"))
        links = settle(_checked(first, sets, least), "links")
        roots = components(links)
        for k in range(ROUNDS + 1):
            named = members.drop("root", "top").join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn(
                "root", F.coalesce("root", "set"))
            classes = named.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("own"))
            largest = classes.groupBy("bucket").agg(F.max(F.struct("own", "root")).alias("top"), F.count(F.lit(1)).alias("n"))
            members = settle(named.join(largest.where("n > 1").select("bucket", F.col("top.root").alias("top")), "bucket"), "mixed")
            if members.isEmpty():
                break
            if k < ROUNDS:
                some = members.groupBy("bucket", "root").agg(
                    F.count(F.lit(1)).alias("own"), F.max(F.struct("known", *TRAITS)).alias("first"))
                place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("own"), "root"))
                probes = some.withColumn("place", place).where(F.col("place") <= CROWD).select("bucket", "root", "first.*")
                once_each = F.lit(True)
            else:
                probes = members.where("root <> top")
                once_each = (F.col("root") == F.col("top")) | (F.col("a_set") < F.col("set"))
            probes = probes.select("bucket", *(F.col(c).alias(f"a_{c}") for c in ("root", *TRAITS)))
            pairs = members.join(probes, "bucket").where((F.col("root") != F.col("a_root")) & once_each & _can_link(least))
            pairs = pairs.select(F.greatest("set", "a_set").alias("u"), F.least("set", "a_set").alias("v"))
            found = _checked(pairs, sets, least)
            roots = components(roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).union(found))
        return block.result(roots.select(F.col("node").alias("set"), "root"), "classes")


def near_copies(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """``doc_id, class_id``: the smallest id of the texts that are near copies of each text, directly or through others.

    Near copies have sets of ``width``-word shingles with a Jaccard similarity of ``least`` or more. Texts without words,
    null or not, are in a class of their own; ``doc_id`` must be a key.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("copy"), "text")
    held = texts.select("doc_id", "copy", once(shingles(F.col("text"), width), _sketch).alias("sketch"))
    rows = settle(held.select("doc_id", "copy", "sketch.*"), "sketches")
    sets = settle(rows.where("set is not null").groupBy("set").agg(
        F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "copy")).alias("key"),
        F.first("size").alias("size"), F.first("buckets").alias("buckets")), "sets")

    def shelf_of(some: DataFrame) -> DataFrame:
        owner = sets.join(some, "set", "left_semi").select(
            "set", F.col("key.doc_id").alias("own_id"), F.col("key.copy").alias("own_copy"))
        found = texts.join(owner, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("copy") == F.col("own_copy")))
        return found.select("set", shingles(F.col("text"), width).alias("hashes")).dropDuplicates(["set"])

    classes = set_classes(sets.select("set", "size", "buckets"), shelf_of, least)
    named = settle(sets.select("set", "first").join(classes, "set", "left").withColumn("root", F.coalesce("root", "set")), "named")
    lowest = named.groupBy("root").agg(F.min("first").alias("class_id"))
    whole = settle(named.join(lowest, "root").select(F.col("set").alias("own"), "class_id"), "lowest")
    return rows.select("doc_id", "set").join(whole, F.col("set") == F.col("own"), "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
