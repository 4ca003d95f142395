"""Written tables, batches and partition-summed arrays that several operators use."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import orelode
from orelode.session import settle, spread, temporary, tidy

__all__ = ["BLOCKS", "emitted", "prepare", "remainder", "settle", "spread", "summed", "temporary", "tidy"]

#: Texts that go to a Python worker at once; bounds its memory whatever the length of the table.
BATCH_ROWS = 250

#: Applications whose executors have been given the package.
_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Makes a session ready: small batches for Python workers, and this package on all of them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(orelode.__file__))
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/orelode", "zip", root, "orelode"))
        _SHIPPED.add(context.applicationId)


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def emitted(blocks: np.ndarray, part: int) -> pa.RecordBatch:
    """The rows of a float64 matrix as (block, part, data) rows for ``summed``."""
    return pa.RecordBatch.from_pydict({
        "block": pa.array(range(len(blocks)), pa.int32()),
        "part": pa.array([part] * len(blocks), pa.int32()),
        "data": pa.array([b.tobytes() for b in blocks], pa.binary())})


BLOCKS = "block int, part int, data binary"


def summed(partials: DataFrame, width: int) -> np.ndarray:
    """Sum over all partitions of the matrices that ``emitted`` made of each, as one matrix.

    Rows with the same number are added in two steps, so that no task gathers the
    rows of all partitions. The result has a fixed size, whatever the input; what was shuffled for it,
    a matrix for each partition, is deleted.
    """

    def total(key: tuple, table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(width)
        for batch in table:
            for data in batch.column("data"):
                acc += np.frombuffer(data.as_buffer(), np.float64)
        yield pa.RecordBatch.from_pydict({
            "block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()),
            "data": pa.array([acc.tobytes()], pa.binary())})

    with tidy(partials.sparkSession):
        first = partials.groupBy("block", (F.col("part") % 32).alias("slice")).applyInArrow(total, BLOCKS)
        rows = first.groupBy("block").applyInArrow(total, BLOCKS).orderBy("block").collect()
    return np.array([np.frombuffer(r["data"], np.float64) for r in rows]).reshape(-1, width)
