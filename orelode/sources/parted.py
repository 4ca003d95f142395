"""Keyed Parquet tables that are changed in parts and switched from one version to the next at once.

A table lies in one folder. Its rows are dealt out to a fixed number of parts by the hash of the key; a change
reads and writes only the parts that its keys fall into, as new files under the number of the new
version. A manifest then lists for each part the version that holds its rows. A version counts once
its manifest is complete, so a reader sees the table before a change or after it, a write that is killed
leaves the old version, and parts that a change does not touch keep their files.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orelode.operators import keyed
from orelode.session import settle, temporary

_PART = "part_no"
_MANIFEST = "part_no int, version long, batch long"


def complete_numbers(spark: SparkSession, folder: str, prefix: str = "") -> list[int]:
    """The numbers that name, after ``prefix``, the completely written folders in ``folder``, ascending."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    path = make(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = [x.getPath().getName() for x in system.listStatus(path)]
    numbers = [n.removeprefix(prefix) for n in names if n.startswith(prefix)]
    return sorted(int(n) for n in numbers if n.isdigit() and system.exists(make(f"{folder}/{prefix}{n}/_SUCCESS")))


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class PartedTable:
    """A table of the columns ``schema`` with the key ``key`` in ``parts`` parts under ``folder``.

    One writer changes it at a time: of two that write the same version the later fails and leaves the other's. Rows with a null in the
    key are rows of a key like others. ``batch`` numbers changes in ascending order; one that was applied
    already is not applied again.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: Sequence[str], parts: int = 64):
        self.spark, self.folder, self.schema, self.key, self.parts = spark, folder.rstrip("/"), schema, list(key), parts

    def versions(self) -> list[int]:
        return complete_numbers(self.spark, f"{self.folder}/manifest")

    def _manifest(self, version: int | None = None) -> dict[int, tuple[int, int | None]]:
        """Version and batch by part: at most ``parts`` rows."""
        versions = self.versions()
        if not versions:
            return {}
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest/{versions[-1] if version is None else version}")
        return {r[_PART]: (r["version"], r["batch"]) for r in rows.collect()}

    def _rows(self, manifest: dict[int, tuple[int, int | None]]) -> DataFrame:
        paths = [f"{self.folder}/rows/version={v}/{_PART}={p}" for p, (v, _) in sorted(manifest.items())]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default; later changes do not show in it."""
        return self._rows(self._manifest(version))

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int").alias(_PART)

    def _change(self, batch: DataFrame, batch_no: int | None, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Writes what ``merged`` makes of the rows of the touched parts and the batch; whether anything was done."""
        versions = self.versions()
        before = self._manifest()
        if batch_no is not None and any(b is not None and b >= batch_no for _, b in before.values()):
            return False
        version = versions[-1] + 1 if versions else 1
        with temporary(self.spark):
            batch = settle(batch, "batch")
            touched = {r[_PART] for r in batch.select(self._part()).distinct().collect()}  # at most ``parts`` numbers
            if not touched:
                return False
            rows = merged(self._rows({p: x for p, x in before.items() if p in touched}), batch)
            # equal sizes of files, also where a key has many of the rows
            rows.select(*self.schema.names, self._part()).hint("rebalance", _PART).write.partitionBy(_PART).mode("overwrite").parquet(
                f"{self.folder}/rows/version={version}")
        newest = max((b for _, b in before.values() if b is not None), default=None) if batch_no is None else batch_no
        after = {p: v for p, (v, _) in before.items()} | {p: version for p in touched}
        self.spark.createDataFrame([(p, v, newest) for p, v in after.items()], _MANIFEST).coalesce(1).write.mode(
            "errorifexists").parquet(f"{self.folder}/manifest/{version}")
        return True

    def upsert(self, batch: DataFrame, now, arrival: str | None = None, update_cols: Sequence[str] | None = None,
               reset: Mapping[str, Column] | None = None, batch_no: int | None = None) -> bool:
        """``keyed.upsert`` into the touched parts."""
        return self._change(batch, batch_no, lambda rows, own: keyed.upsert(rows, own, self.key, now, arrival, update_cols, reset))

    def replace(self, batch: DataFrame, batch_no: int | None = None) -> bool:
        """All rows of the batch's keys are replaced by the batch, in the touched parts."""
        return self._change(batch.select(*self.schema.names), batch_no, lambda rows, own: keyed.replace_by_key(rows, own, self.key))

    def vacuum(self, keep: int = 2) -> None:
        """Deletes what none of the newest ``keep`` versions needs, remains of killed writes included."""
        versions = self.versions()
        kept = versions[-keep:]
        needed = {(v, p) for n in kept for p, (v, _) in self._manifest(n).items()}
        for n in versions[:-keep]:
            delete_folder(self.spark, f"{self.folder}/manifest/{n}")
        for version in range(1, (kept[-1] if kept else 0) + 2):
            own = {p for v, p in needed if v == version}
            for p in range(self.parts) if own else [None]:
                if p not in own:
                    delete_folder(self.spark, f"{self.folder}/rows/version={version}" + (f"/{_PART}={p}" if own else ""))
