"""Session settings the operators rely on, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows that may be broadcast whatever is in them: some 10 MB at the widest rows here.
FEW = 1 << 16

#: Folders made in each open block of ``temporary``, the innermost last.
_OPEN: list[list[str]] = []


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("orelode")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables and streaming checkpoints, deleted when the application ends.

    It lies in the shared folder the cluster names. Only where none is named and all tasks
    run in this one process is a folder of our own set for the session.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors can reach")
        base = f"{tempfile.gettempdir()}/orelode-{spark.sparkContext.applicationId}"
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    system, path = _file_system(spark, folder)
    system.deleteOnExit(path)
    if _OPEN:
        _OPEN[-1].append(folder)
    return folder


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """A block whose queries delete their shuffle files as each ends, not when the driver happens to collect its garbage.

    A long job runs many queries and gives the driver little garbage, so the files of all of them would stay.
    """
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)


def settle(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back.

    Cuts the lineage of a table that several branches of a job use, survives lost
    executors, and gives the planner its true size. What was shuffled for it is deleted.
    """
    folder = work_folder(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as a side of a join that is dealt out by its key, however small Spark takes it to be.

    Spark takes the rows of an explode to be as large as those they were made of, and written rows to be as large as their
    compressed files. A side sized too low would be broadcast, and so gathered on the driver. Where neither side can have much more
    than ``rows``, and these are ``FEW`` at most, Spark chooses.
    """
    return df if rows is not None and rows <= FEW else df.hint("merge")


class _Temporary:
    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._folders: list[str] = []

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written so that it outlives the block."""
        out = settle(df, name)
        folder = self._folders.pop()
        if len(_OPEN) > 1:
            _OPEN[-2].append(folder)
        return out


@contextmanager
def temporary(spark: SparkSession) -> Iterator[_Temporary]:
    """A block whose tables in the shared folder are deleted at its end, but for its ``result``.

    Only written results may leave the block: what is still to be computed from its tables cannot be.
    """
    block = _Temporary(spark)
    _OPEN.append(block._folders)
    try:
        yield block
    finally:
        _OPEN.pop()
        for folder in block._folders:
            system, path = _file_system(spark, folder)
            system.delete(path, True)
