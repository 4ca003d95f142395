"""Approximate nearest neighbours by learned partitions of a neighbour graph.

A bounded sample of the vectors is linked to a graph of nearest neighbours and the graph
is cut into partitions of equal size with few links between them. A small classifier
learns to name the partition of a vector. It assigns every row of the table to its most
probable partition, and sends a query to several most probable ones, where all rows are
ranked by their exact inner product.

Equal vectors are indexed once, with as many of their ids as a result can hold, which
loses nothing. Large partitions are split into blocks, so that no task gathers one whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelode.llm.shared import settle

TOP = 20
#: Vectors of the sample that graph and classifier are fitted on.
SAMPLE = 8192
PARTITIONS = 32
#: Partitions that a query is sent to.
ROUTES = 24
#: Links of a sample vector, sweeps of the cut, hidden units and passes of the classifier.
LINKS = 12
SWEEPS = 12
HIDDEN = 128
PASSES = 20
SEED = 11
#: Rows of a block of a partition, queries of a block of them (nearly), and queries that meet at once.
BLOCK = 4096
QUERY_BLOCK = 4096
QUERIES_AT_ONCE = 256


def graph(x: np.ndarray) -> np.ndarray:
    """The ``LINKS`` others with the largest inner product of each row, as row numbers."""
    links = min(LINKS, len(x) - 1)
    out = np.zeros((len(x), links), np.int64)
    for at in range(0, len(x), 1024):
        near = x[at:at + 1024] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at:at + len(near)] = np.argpartition(-near, links - 1, axis=1)[:, :links]
    return out


def cut(x: np.ndarray, links: np.ndarray, parts: int) -> np.ndarray:
    """A balanced partition of the graph: parts of equal size, give or take a tenth, with few links between them.

    It begins with slices along halving directions of greatest variance and is improved by
    sweeps in which nodes go where most of their links are, those that gain most first, as
    long as there is room.
    """
    label = np.zeros(len(x), np.int64)
    pieces = 1
    while pieces < parts:
        for p in range(pieces):
            own = np.flatnonzero(label == p)
            if len(own) > 1:
                centred = x[own] - x[own].mean(axis=0)
                direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
                order = own[np.argsort(centred @ direction, kind="stable")]
                label[order[len(order) // 2:]] = p + pieces
        pieces *= 2
    most = int(np.ceil(1.1 * len(x) / pieces))
    source = np.repeat(np.arange(len(x)), links.shape[1])
    target = links.reshape(-1)
    for _ in range(SWEEPS):
        votes = np.zeros((len(x), pieces), np.int32)
        np.add.at(votes, (source, label[target]), 1)
        np.add.at(votes, (target, label[source]), 1)
        here = votes[np.arange(len(x)), label]
        best = votes.argmax(axis=1)
        gain = votes.max(axis=1) - here
        size = np.bincount(label, minlength=pieces)
        moved = 0
        for node in np.argsort(-gain, kind="stable"):
            if gain[node] <= 0:
                break
            if size[best[node]] < most:
                size[label[node]] -= 1
                size[best[node]] += 1
                label[node] = best[node]
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """A classifier with one hidden layer that gives each partition a score."""

    mean: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    outer: np.ndarray

    def hidden(self, x: np.ndarray) -> np.ndarray:
        z = np.hstack(((x - self.mean) / self.scale, np.ones((len(x), 1))))
        return np.hstack((np.maximum(z @ self.inner, 0), np.ones((len(x), 1))))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.outer


def fit(x: np.ndarray, parts: int = PARTITIONS) -> Router:
    """Cuts the graph of a sample and trains the router by gradient descent with momentum."""
    while parts > 1 and len(x) < 16 * parts:
        parts //= 2
    links = graph(x)
    label = cut(x, links, parts) if len(x) > 1 else np.zeros(len(x), np.int64)
    draw = np.random.default_rng(SEED)
    scale = max(float(x.std()), 1e-12)
    router = Router(x.mean(axis=0), np.full(x.shape[1], scale),
                    draw.normal(size=(x.shape[1] + 1, HIDDEN)) * np.sqrt(2 / (x.shape[1] + 1)),
                    draw.normal(size=(HIDDEN + 1, parts)) * 0.01)
    if parts == 1:
        return router
    # a vector belongs to its own partition and, in part, to those of its neighbours
    goal = np.eye(parts)[label] * 0.5 + 0.5 * np.eye(parts)[label[links]].mean(axis=1)
    speed = [np.zeros_like(router.inner), np.zeros_like(router.outer)]
    for turn in range(PASSES):
        rate = 0.1 * (1 - turn / PASSES)
        order = draw.permutation(len(x))
        for at in range(0, len(x), 128):
            rows = order[at:at + 128]
            h = router.hidden(x[rows])
            s = h @ router.outer
            p = np.exp(s - s.max(axis=1, keepdims=True))
            error = (p / p.sum(axis=1, keepdims=True) - goal[rows]) / len(rows)
            z = np.hstack(((x[rows] - router.mean) / router.scale, np.ones((len(rows), 1))))
            slopes = (z.T @ ((error @ router.outer[:-1].T) * (h[:, :-1] > 0)), h.T @ error)
            for v, g, w in zip(speed, slopes, (router.inner, router.outer), strict=True):
                v *= 0.9
                v -= rate * g
                w += v
    return router


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def routes(vector: Column, router: Router, count: int) -> Column:
    """The ``count`` most probable partitions of a vector, most probable first."""

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            if len(batch):
                order = np.argsort(-router.scores(matrix(batch)), axis=1, kind="stable")[:, :count]
                yield pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))
            else:
                yield pa.array([], pa.list_(pa.int32()))

    return F.arrow_udf(found, "array<int>")(vector)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part: with an id, and a vector of the usual length that is finite and not zero."""
    x = F.col("vector")
    ok = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(
        F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
        & F.exists(x, lambda c: c != 0))
    usual = ok.groupBy(F.size(x).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return ok.where(F.size(x) == (usual[0]["n"] if usual else 0))


RANKED = "query_id long, query_key long, vec_id long, score double"


def _rank(top: int):
    def ranked(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """The best ``top`` rows of a block for every query; scores are added up in one order everywhere."""
        parts = [pd.DataFrame({"query_id": [], "query_key": [], "vec_id": [], "score": []}).astype(
            {"query_id": "int64", "query_key": "int64", "vec_id": "int64", "score": "float64"})]
        if len(queries) and len(rows):
            x = np.stack(rows["vector"].to_numpy()).astype(np.float64)
            own = rows["ids"].to_numpy()
            repeats = np.unique(np.concatenate(own), return_counts=True)
            repeats = repeats[1][np.isin(repeats[0], queries["query_id"].to_numpy())].max(initial=0)
            keep = min(len(x), top + repeats)  # vectors with the id of the query may be among them
            length = np.linalg.norm(x, axis=1).max()
            for at in range(0, len(queries), QUERIES_AT_ONCE):
                part = queries.iloc[at:at + QUERIES_AT_ONCE]
                q = np.stack(part["vector"].to_numpy()).astype(np.float64)
                near = q @ x.T
                # products that tie may differ by rounding here, so all within the margin are ranked exactly
                margin = 4 * x.shape[1] * np.finfo(np.float64).eps * length * np.linalg.norm(q, axis=1)
                least = np.partition(near, len(x) - keep, axis=1)[:, len(x) - keep] - margin
                for k, (i, j, v) in enumerate(zip(part["query_id"], part["query_key"], q, strict=True)):
                    best = np.flatnonzero(near[k] >= least[k])
                    score = (x[best] * v).sum(axis=1)
                    ids = np.concatenate([own[b] for b in best])
                    score = np.repeat(score, [len(own[b]) for b in best])
                    other = ids != i
                    ids, score = ids[other], score[other]
                    order = np.lexsort((ids, -score))[:top]
                    parts.append(pd.DataFrame({"query_id": i, "query_key": j, "vec_id": ids[order], "score": score[order]}))
        return pd.concat(parts)

    return ranked


def nearest(vectors: DataFrame, is_query: Column, top: int = TOP, parts: int = PARTITIONS, count: int = ROUTES,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``top`` rows with the largest inner product with each query, itself excepted.

    ``is_query`` is a condition on the column ``vec_id``. Columns: ``query_id``, ``rank`` (from 1),
    ``vec_id``, ``score`` (the exact product of the original vectors, in double precision);
    ties go to the smaller id. Rows without id, and vectors that are null, empty, zero, of
    another length than most, or hold null or non-finite components take no part. Rows that
    repeat an id and vector count once; other rows with the id of a query are no candidates
    of it, and an id with several vectors is a query with each. Other columns are not read.
    """
    rows = settle(usable(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
                         ).dropDuplicates(["vec_id", "vector"]), "vectors")
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    first = rows.withColumn("place", place).where(F.col("place") <= top + 1)
    distinct = settle(first.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "distinct")
    # the hash order makes the bounded sample the same on every run
    sample = distinct.select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE).toArrow()["vector"].combine_chunks()
    if not len(sample):
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id",
                           F.lit(0.0).alias("score")).where("false")
    router = fit(matrix(sample), parts)
    index = settle(distinct.withColumn("part", routes(F.col("vector"), router, 1)[0]), "index")
    sizes = index.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row for each part
    index = index.join(F.broadcast(sizes), "part").withColumn(
        "block", F.pmod(F.xxhash64("vector"), F.col("blocks")).cast("int"))
    routed = settle(rows.where(is_query).withColumn("query_key", F.xxhash64("vector")).withColumn(
        "parts", routes(F.col("vector"), router, count)), "queries")
    asked = routed.select(F.explode("parts").alias("part")).groupBy("part").agg(
        F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks"))  # a row for each part
    sizes = sizes.join(F.broadcast(asked), "part")
    # both sides of a group are blocks of bounded size, however many rows and queries a part has
    queries = routed.withColumn("part", F.explode("parts")).join(F.broadcast(sizes), "part").withColumn(
        "query_block", F.pmod(F.xxhash64("query_key", "vec_id"), F.col("query_blocks")).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    queries = queries.select(F.col("vec_id").alias("query_id"), "query_key", "vector", "part", "block", "query_block")
    index = index.join(F.broadcast(asked), "part").withColumn(
        "query_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
    group = "part", "block", "query_block"
    ranked = queries.groupBy(*group).cogroup(
        index.select("vector", "ids", *group).groupBy(*group)).applyInPandas(_rank(top), RANKED)
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select(
        "query_id", "rank", "vec_id", "score")
