"""Newest, best and first rows per key.

Each is a ``row_number`` bound, which Spark also applies inside every map task
before the shuffle, so a key that holds a third of all rows sends at most ``n``
rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK = "rank_in_key"
# Spark's own bound in the map tasks applies up to this rank
_MAP_SIDE_LIMIT = 1000
_SALT, _SALTS = "rank_salt", 64
_ATOMIC = ("string", "bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "date", "timestamp",
           "timestamp_ntz", "binary")


def top_n_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, keep_rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each key in the given order, which must be total.

    A bound beyond what Spark applies in the map tasks is taken in two steps: the
    first ``n`` of each of many slices of a key, then the first ``n`` of those.
    """
    if n > _MAP_SIDE_LIMIT:
        hashed = [c for c, kind in df.dtypes if kind in _ATOMIC or kind.startswith("decimal")]
        sliced = df.withColumn(_SALT, F.pmod(F.xxhash64(*hashed), F.lit(_SALTS)))
        in_slice = F.row_number().over(Window.partitionBy(*keys, _SALT).orderBy(*order))
        df = sliced.withColumn(RANK, in_slice).filter(F.col(RANK) <= n).drop(RANK, _SALT)
    ranked = df.withColumn(RANK, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(RANK) <= n)
    return ranked.withColumnRenamed(RANK, keep_rank) if keep_rank else ranked.drop(RANK)


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_n_per(df, keys, order, 1)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Order-preserving distinct: the first row of each key."""
    return top_n_per(df, keys, order, 1)


def first_rows(df: DataFrame, order: Sequence[Column], n: int | None) -> DataFrame:
    """Sorted rows, at most ``n``; no limit for 0 or None."""
    ordered = df.orderBy(*order)
    return ordered.limit(n) if n else ordered


def with_percent_rank(df: DataFrame, group: str, column: str, out: str, slices: int) -> DataFrame:
    """``df`` with ``percent_rank`` of ``column`` within ``group``, missing values lowest, for groups too large for a task.

    The different values of a group are counted in the map tasks and cut into ``slices`` ranges of values at
    approximate quantiles. What is smaller than a value is in earlier slices, of which there is a row each, or in its own,
    the only rows that a task sorts. The ranges decide how ranks are found, never which.
    """
    counts = df.groupBy(group, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    cuts = df.groupBy(F.col(group).alias("cut_group")).agg(F.percentile_approx(
        F.col(column).cast("double"), [k / slices for k in range(1, slices)]).alias("cuts"), F.count(F.lit(1)).alias("whole"))
    value = F.col("value").cast("double")
    placed = counts.join(cuts, F.col(group).eqNullSafe(F.col("cut_group"))).select(
        group, "value", "n", "whole", F.when(F.col("value").isNull(), F.lit(-1)).otherwise(
            F.size(F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda c: c < value))).alias("slice"))
    before = Window.partitionBy(group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(group, "slice").agg(F.sum("n").alias("own")).select(
        F.col(group).alias("size_group"), F.col("slice").alias("size_slice"), F.coalesce(F.sum("own").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy(group, "slice").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    smaller = placed.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(
        sizes, F.col(group).eqNullSafe(F.col("size_group")) & (F.col("slice") == F.col("size_slice")))
    share = F.when(F.col("whole") > 1, (F.col("earlier") + F.col("inside")) / (F.col("whole") - 1)).otherwise(F.lit(0.0))
    ranks = smaller.select(F.col(group).alias("rank_group"), F.col("value").alias("rank_value"), share.alias(out))
    return df.join(ranks, F.col(group).eqNullSafe(F.col("rank_group")) & F.col(column).eqNullSafe(F.col("rank_value"))).drop(
        "rank_group", "rank_value")
