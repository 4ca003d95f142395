"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.shared import settle, spread, temporary, tidy


def _with_smallest(edges: DataFrame, rows: int | None) -> DataFrame:
    """Edges (u, v), some ``rows`` of them, with ``m``, the smallest v of their u: counted in the map tasks, joined back by u."""
    smallest = edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    return edges.join(spread(smallest, rows), F.col("u") == F.col("k")).select("u", "v", "m")


def _both_ways(edges: DataFrame) -> DataFrame:
    """Every edge (u, v) and (v, u), from one reading of the edges."""
    ways = F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.explode(ways).alias("way")).select("way.u", "way.v")


def _large_star(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Ties every larger neighbour of a node to the smallest node around it."""
    near = _with_smallest(_both_ways(edges), rows).where("v > u")
    return near.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Ties a node and its smaller neighbours to the smallest of them."""
    tied = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
    near = _with_smallest(edges, rows).select(F.explode(tied).alias("way")).select("way.u", "way.v")
    return near.where("u <> v").distinct()


def _shape(edges: DataFrame) -> tuple[bool, int]:
    """Whether distinct edges (u, v), v the smaller, are stars: each u has one, and none of them is a v; and their number."""
    ways = F.array(*(F.struct(F.col(c).alias("node"), F.lit(c == "u").cast("int").alias("below"), F.lit(c == "v").cast("int").alias("above"))
                     for c in "uv"))
    ends = edges.select(F.explode(ways).alias("end")).groupBy("end.node").agg(
        (F.sum("end.below") + F.max("end.above")).alias("ties"), F.sum("end.below").alias("below"))
    with tidy(edges.sparkSession):
        ties, rows = ends.agg(F.max("ties"), F.sum("below")).first()
    return (ties or 0) <= 1, rows or 0


def star_forest(links: DataFrame) -> DataFrame:
    """(u, v) for every node u but the smallest of its component, v being that smallest node.

    ``links`` has two columns of one ordered type; direction, repeats and loops do not
    matter, links with a null end are left out. Alternates large and small stars, which
    keep the components and end in stars, until the edges are stars; links that are stars
    already take no round. The rounds grow with the logarithm of the longest chain. Each round is a written table.
    """
    a, b = (F.col(c) for c in links.columns)
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        a.isNotNull() & b.isNotNull() & (a != b)).distinct()
    edges = settle(edges, "links")
    while True:
        stars, rows = _shape(edges)
        if stars:
            return edges
        with temporary(edges.sparkSession) as block:
            edges = block.result(_small_star(_large_star(edges, rows), rows), "links")
