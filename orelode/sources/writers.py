"""Writers. Tables are written beside the one that was read, never over it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from orelode.functions.keys import empty_to_null


def write_json(df: DataFrame, path: str, sorted_keys: bool = False, mode: str = "errorifexists") -> None:
    (df.select(*sorted(df.columns)) if sorted_keys else df).write.mode(mode).json(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Parquet with the sink's null rule: empty strings are NULL."""
    writer = empty_to_null(df).write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
