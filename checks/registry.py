"""Where the query modules list their queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orelode.functions.times import iso_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared table; its schema is looked up once and then given to the reader."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts. The shared tables are single files that Spark cannot split, so they are dealt out."""
    return table(spark, sf_dir, name).repartition(spark.sparkContext.defaultParallelism)


def plain(df: DataFrame) -> DataFrame:
    """Times and dates as text, so that both engines print them alike."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("timestamp", "timestamp_ntz"):
            out.append(iso_text(F.col(name)).alias(name))
        elif kind == "date":
            out.append(F.col(name).cast("string").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
