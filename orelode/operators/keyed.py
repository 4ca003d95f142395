"""Keyed writes as DataFrames: upsert, alert upsert, replace by key.

The target is never shuffled for a small batch: every join has the batch, or
something no longer than it, on the side Spark may broadcast, and Spark does so
only below its size threshold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.functions.times import moment
from orelode.operators.ranking import keep_first
from orelode.session import settle

_HIT = "batch_row_present"


def last_per_key(batch: DataFrame, key: Sequence[str], arrival: str | None) -> DataFrame:
    """One row per key, the last to arrive; without an order a key with two rows is an error."""
    if arrival is None:
        rest = [F.first(c).alias(c) for c in batch.columns if c not in key]
        one = batch.groupBy(*key).agg(F.count(F.lit(1)).alias(_HIT), *rest)
        return one.filter(F.assert_true(F.col(_HIT) == 1, F.lit("rows of one key need an order of arrival")).isNull()).drop(_HIT)
    return keep_first(batch, key, [F.col(arrival).desc()]).drop(arrival)


def upsert(target: DataFrame, batch: DataFrame, key: Sequence[str], now, arrival: str | None = None,
           update_cols: Sequence[str] | None = None, reset: Mapping[str, Column] | None = None) -> DataFrame:
    """Insert new keys and update known ones.

    ``created_at`` and ``updated_at`` are kept by the operator: inserts set both
    to ``now``, updates only the second. ``update_cols`` are the columns an
    update overwrites, all non-key columns by default; ``reset`` gives columns a
    fixed value on update. ``arrival`` orders rows of one key within the batch. The batch is
    worked out once, to one row per key in the shared folder.
    """
    key = list(key)
    stamp = moment(now)
    rows = settle(last_per_key(batch, key, arrival), "batch")
    payload = [c for c in target.columns if c not in key and c not in ("created_at", "updated_at")]
    changed = [c for c in payload if c in rows.columns] if update_cols is None else list(update_cols)
    fixed = dict(reset or {})

    incoming = rows.select(*key, *[F.col(c).alias(f"new_{c}") for c in payload if c in rows.columns],
                           F.lit(True).alias(_HIT))
    joined = target.join(incoming, key, "left")
    hit = F.col(_HIT).isNotNull()

    def after(c: str) -> Column:
        if c in fixed:
            return F.when(hit, fixed[c]).otherwise(F.col(c)).alias(c)
        if c in changed:
            return F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
        return F.col(c)

    updated = joined.select(*key, *[after(c) for c in payload], F.col("created_at"),
                            F.when(hit, stamp).otherwise(F.col("updated_at")).alias("updated_at"))

    known = target.select(*key).join(rows.select(*key), key, "left_semi")
    fresh = rows.join(known, key, "left_anti")
    inserted = fresh.select(
        *key,
        *[F.col(c) if c in rows.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in payload],
        stamp.alias("created_at"), stamp.alias("updated_at"))
    return updated.unionByName(inserted)


def upsert_alerts(target: DataFrame, alerts: DataFrame, now, arrival: str | None = None) -> DataFrame:
    """Repeat of a known alert updates severity, message and time, and opens it again."""
    unresolved = F.lit(None).cast(target.schema["resolved_at"].dataType)
    return upsert(target, alerts, ["id"], now, arrival, update_cols=["severity", "message", "sent_at"],
                  reset={"resolved_at": unresolved})


def replace_by_key(target: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """All rows of the batch's keys are replaced by the batch."""
    key = list(key)
    return target.join(batch.select(*key).distinct(), key, "left_anti").unionByName(batch)
