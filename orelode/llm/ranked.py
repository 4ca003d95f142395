"""Ranked lexical search by norm buckets of impact vectors, as in LEMP.

A document is the vector of its terms' impacts, a query that of its terms' weights, and the score their product.
Documents are put in buckets by the length of their vectors. The buckets of the longest documents
are searched first; the k-th best score found there is a bound that every further document has
to reach. By Cauchy-Schwarz a document shorter than the bound divided by the length of the query cannot,
so whole buckets are left out, for all queries by a filter of the scan and for single ones in the tasks. Inside a bucket
the heaviest coordinates of a query are taken as they are and the rest is bounded by the lengths of
what remains of both vectors; what may still reach the bound is scored anew in integers.

Only the terms of the queries are coordinates. Tasks send the k best documents of each query on, and nothing is
left out but what k others surely precede.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelode.llm.licenses import WORDS
from orelode.llm.shared import settle

#: Queries, and bytes of their texts, that are searched at once; one query is never divided.
ITEMS = 2000
BYTES = 1 << 23
#: Queries of a group, and coordinates of a query that its bound takes as they are.
GROUP = 64
FOCUS = 12
#: Documents of the first, longest buckets.
FIRST = 4096
#: Documents that a task takes at once, and those of them that are one bucket.
HELD = 2048
BUCKET = 256
#: Bounds are made this much larger, which is far more than the error of their sums.
MARGIN = 1 + 1e-6

IMPACT = 1_000_000_000
BEST = "query int, none boolean, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits, A-Z in lower case, everything outside ASCII being a letter."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


@dataclass
class Query:
    """Places of the distinct terms of a text in the vocabulary, and weight times repeats of each."""

    terms: np.ndarray
    weights: np.ndarray


def counted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(none, doc_id, n, terms, times): how many terms a text has, and how often those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of one block of queries

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for batch in batches:
            sizes, ends, places, times = [], [0], [], []
            for text in batch:
                words = terms_of(text.as_py())
                found = Counter(filter(known.__contains__, words))
                sizes.append(len(words))
                places += map(known.__getitem__, found)
                times += found.values()
                ends.append(len(places))
            yield pa.StructArray.from_arrays([
                pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32())),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(times, pa.int64()))], ["n", "terms", "times"])

    found = F.arrow_udf(count, "struct<n:long,terms:array<int>,times:array<long>>")(F.col(text_col))
    return docs.select(F.col(id_col).isNull().alias("none"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"),
                       found.alias("found")).select("none", "doc_id", "found.*")


def impacts(counts: DataFrame, documents: int, terms: int) -> DataFrame:
    """(none, doc_id, terms, impacts, length): the vectors of the documents that have a coordinate above 0."""
    longer = F.expr(f"100 - 75 + cast((cast(75 as decimal(38,0)) * n * {documents}) div {max(1, terms)} as bigint)")
    impact = F.transform("times", lambda t: F.call_function("div", F.lit(IMPACT) * t, 1000 * t + 8 * F.col("longer")))
    rows = counts.where("size(terms) > 0").withColumn("longer", longer).withColumn("impacts", impact)
    length = F.sqrt(F.aggregate("impacts", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return rows.select("none", "doc_id", "terms", "impacts", length.alias("length")).where("length > 0")


class Group:
    """Queries searched together, on their own terms only."""

    def __init__(self, numbers: list[int], queries: list[Query], size: int):
        self.numbers = numbers
        self.terms = np.unique(np.concatenate([x.terms for x in queries]))
        self.place = np.full(size, -1, np.int32)
        self.place[self.terms] = range(len(self.terms))
        self.queries = [Query(self.place[x.terms], x.weights) for x in queries]
        self.focus = np.zeros((len(self.terms), len(queries)))  # weights of the heaviest coordinates, and what the others weigh
        self.rest, self.length = np.zeros(len(queries)), np.zeros(len(queries))
        for k, x in enumerate(self.queries):
            order = np.argsort(-x.weights, kind="stable")
            self.focus[x.terms[order[:FOCUS]], k] = x.weights[order[:FOCUS]]
            self.rest[k] = np.linalg.norm(x.weights[order[FOCUS:]].astype(float))
            self.length[k] = np.linalg.norm(x.weights.astype(float))
        self.marks = (self.focus > 0).astype(float)


class Best:
    """The documents of the highest scores so far of one query; of equal scores those of smaller ids, null ids last."""

    def __init__(self, top: int, bound: int):
        self.top, self.bound = top, max(1, bound)
        self.rows = np.zeros((3, 0), np.int64)  # minus score, id is null, id

    def add(self, scores: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.bound
        rows = np.hstack([self.rows, np.array([-scores[keep], none[keep], ids[keep]], np.int64)])
        self.rows = rows[:, np.lexsort(rows[::-1])[:self.top]]
        if self.rows.shape[1] == self.top:
            self.bound = max(self.bound, int(-self.rows[0, -1]))


class Search:
    """A task's search: batches of vectors in, the best documents of each query out."""

    def __init__(self, groups: list[Group], bounds: list[int], top: int):
        self.groups, self.top = groups, top
        self.best = [Best(top, b) for b in bounds]

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= HELD:
                self._block(held)
                held = []
        if held:
            self._block(held)
        for k, best in enumerate(self.best):
            score, none, ids = best.rows
            yield pa.RecordBatch.from_pydict({
                "query": pa.array([k] * len(ids), pa.int32()), "none": pa.array(none == 1), "doc_id": pa.array(ids),
                "score": pa.array(-score)})

    def _block(self, held: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(held).combine_chunks()
        none, ids, length = (table[c].to_numpy() for c in ("none", "doc_id", "length"))
        terms, values = (table[c].combine_chunks() for c in ("terms", "impacts"))
        ends = terms.offsets.to_numpy()
        terms, values = terms.values.to_numpy(), values.values.to_numpy()
        order = np.argsort(-length, kind="stable")  # longest first, cut into buckets
        for at in range(0, len(order), BUCKET):
            rows = order[at:at + BUCKET]
            size = ends[rows + 1] - ends[rows]
            owner = np.repeat(np.arange(len(rows)), size)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ends[rows], size)
            for group in self.groups:
                self._bucket(group, length[rows[0]], owner, terms[place], values[place], none[rows], ids[rows])

    def _bucket(self, group: Group, longest: float, owner: np.ndarray, terms: np.ndarray, values: np.ndarray,
                none: np.ndarray, ids: np.ndarray) -> None:
        bounds = np.array([self.best[k].bound for k in group.numbers], float)
        open_ = np.flatnonzero(longest * group.length * MARGIN >= bounds)  # by Cauchy-Schwarz the others have nothing here
        if not len(open_):
            return
        place = group.place[terms]
        keep = place >= 0
        vectors = np.zeros((len(ids), len(group.terms)), np.int64)
        vectors[owner[keep], place[keep]] = values[keep]
        real = vectors.astype(float)
        part = real @ group.focus[:, open_]
        np.square(real, out=real)
        remains = np.maximum(real.sum(axis=1)[:, None] - (real @ group.marks[:, open_]) / MARGIN, 0)
        reach = (part + np.sqrt(remains) * group.rest[open_]) * MARGIN
        for k, q in enumerate(open_.tolist()):
            best = self.best[group.numbers[q]]
            rows = np.flatnonzero(reach[:, k] >= best.bound)
            if len(rows):
                query = group.queries[q]
                scores = vectors[np.ix_(rows, query.terms)] @ query.weights
                best.add(scores, none[rows], ids[rows])


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "none", "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search(vectors: DataFrame, groups: list[Group], bounds: list[int], top: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(groups)  # of one block of queries

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from Search(shared.value, bounds, top).run(batches)

    return settle(vectors.select("none", "doc_id", "terms", "impacts", "length").mapInArrow(best, BEST), "best")


def _first_length(vectors: DataFrame) -> float:
    """The length from which on at least ``FIRST`` documents are, in steps of an eighth of an octave."""
    step = F.floor(8 * F.log2("length")).alias("step")
    seen = 0
    rows = vectors.groupBy(step).count().orderBy(F.desc("step")).collect()  # a few hundred steps at most, as lengths are bounded
    for r in rows:
        seen += r["count"]
        if seen >= FIRST:
            return 2.0 ** (r["step"] / 8)
    return 0.0


def _block(spark: SparkSession, texts: list[str], docs: DataFrame, top: int, id_col: str, text_col: str) -> DataFrame:
    """(query, none, doc_id, score, rank) of a block of queries."""
    bags = [Counter(terms_of(x)) for x in texts]
    vocabulary = {t: k for k, t in enumerate(sorted(set().union(*bags)))}
    counts = settle(counted(docs, vocabulary, id_col, text_col), "terms")
    sums = counts.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    documents = sums["documents"]
    holding = dict(counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # one row a term at most
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * holding.get(k, 0) + 1))) for k in range(len(vocabulary))]
    queries = []
    for bag in bags:
        own = [vocabulary[t] for t in bag]
        queries.append(Query(np.array(own, np.int64), np.array([n * weight[k] for k, n in zip(own, bag.values(), strict=True)], np.int64)))
    some = [k for k, x in enumerate(queries) if len(x.terms)]
    groups = [Group(own, [queries[k] for k in own], len(vocabulary)) for own in (some[k:k + GROUP] for k in range(0, len(some), GROUP))]
    vectors = settle(impacts(counts, documents, sums["terms"]), "vectors")
    start = _first_length(vectors)
    first = _search(vectors.where(F.col("length") >= start), groups, [1] * len(queries), top)
    bounds = [1] * len(queries)
    for r in _ranked(first, top).where(F.col("rank") == top).select("query", "score").collect():  # one row a query
        bounds[r["query"]] = r["score"]
    needed = min((bounds[k] / (x * MARGIN) for g in groups for k, x in zip(g.numbers, g.length.tolist(), strict=True) if x),
                 default=math.inf)
    rest = vectors.where((F.col("length") < start) & (F.col("length") >= needed))
    return _ranked(first.union(_search(rest, groups, bounds, top)), top)


def ranked(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``top`` documents of highest score for each item: ``item_id``, ``rank`` (from 1), the id, ``score``.

    ``items`` has ``item_id`` and ``text``. Scores are above 0; equal ones are ranked by ascending id, rows with a
    null id last. Null and empty texts have no terms: such documents are not counted and never found, such items
    have no rows. Each row of both tables stands for itself, so repeated documents are each ranked and repeated
    items each answered; without documents or items there are no rows. Other columns are not read. Items are
    searched in blocks of a bounded number of rows and bytes, each with one pass over the texts.
    """
    spark = docs.sparkSession
    asked = items.where("text is not null").select("item_id", "text")
    size = asked.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(-(-size["rows"] // ITEMS), -(-size["bytes"] // BYTES))
    out = spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, {id_col} long, score long")
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        found = _block(spark, [r["text"] for r in own], docs, top, id_col, text_col)
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(own)],
                                      f"number int, item_id {dict(items.dtypes)['item_id']}")
        rows = found.join(names, F.col("query") == F.col("number")).select(
            "item_id", "rank", F.when(~F.col("none"), F.col("doc_id")).alias(id_col), "score")
        out = out.union(rows)
    return out
