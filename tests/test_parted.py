import os

import pytest
from pyspark.sql import functions as F

from orelode.operators import keyed
from orelode.sources.parted import PartedTable
from orelode.streaming import feeds

SCHEMA = "id long, kind string, value long, created_at timestamp_ntz, updated_at timestamp_ntz"


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def held(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return PartedTable(spark, str(tmp_path / "held"), schema, ["id"], parts=8)


def batch(spark, ids, kind):
    return spark.createDataFrame([(i, kind, 10 * i if i is not None else 0) for i in ids], "id long, kind string, value long")


def test_versions_equal_whole_upserts(spark, held):
    whole, seen = held.read(), []
    for n, ids in enumerate(([1, 2, 3, None], [3, 4], range(50), [7])):
        own = batch(spark, ids, f"k{n}")
        whole = keyed.upsert(whole, own, ["id"], f"2024-01-0{n + 1}T00:00:00Z")
        assert held.upsert(own, f"2024-01-0{n + 1}T00:00:00Z", batch_no=n)
        assert not held.upsert(own, "2025-01-01T00:00:00Z", batch_no=n)  # run again
        seen.append(rows_of(whole))
        assert rows_of(held.read()) == seen[-1]
    assert [rows_of(held.read(v)) for v in held.versions()] == seen
    held.vacuum(keep=1)
    assert held.versions() == [4] and rows_of(held.read()) == seen[-1]


def test_untouched_parts_keep_their_files(spark, held):
    held.upsert(batch(spark, range(100), "a"), "2024-01-01T00:00:00Z")
    before = files(held.folder)
    held.upsert(batch(spark, [5], "b"), "2024-01-02T00:00:00Z")
    new = {x for x in files(held.folder) - before if "/rows/" in x}
    assert before <= files(held.folder) and len({os.path.dirname(x) for x in new}) == 1
    read = {x.removeprefix("file://") for x in held.read().inputFiles()}
    assert len(read & before) >= 7 and read & new


def test_killed_write_leaves_the_old_version(spark, held, monkeypatch):
    held.upsert(batch(spark, range(20), "a"), "2024-01-01T00:00:00Z")
    want = rows_of(held.read())
    dies = F.udf(lambda k: 1 / 0, "string")
    with pytest.raises(Exception, match="division"):
        held.upsert(batch(spark, range(20), "b").withColumn("kind", dies("kind")), "2024-01-02T00:00:00Z")
    assert rows_of(held.read()) == want
    # killed after some rows and before the manifest is complete: what is there of version 2 does not count
    os.makedirs(f"{held.folder}/rows/version=2/part_no=0")
    batch(spark, [1], "half").write.parquet(f"{held.folder}/rows/version=2/part_no=1")
    os.makedirs(f"{held.folder}/manifest/2")
    assert rows_of(held.read()) == want and held.versions() == [1]
    os.rmdir(f"{held.folder}/manifest/2")
    held.upsert(batch(spark, [1], "d"), "2024-01-02T00:00:00Z")
    assert {r.kind for r in held.read().where("id = 1").collect()} == {"d"} and held.read().count() == 20


def test_replace_by_key_with_many_rows_of_a_key(spark, tmp_path):
    schema = spark.createDataFrame([], "symbol string, n long").schema
    held = PartedTable(spark, str(tmp_path / "r"), schema, ["symbol"], parts=4)
    held.replace(spark.createDataFrame([(f"S{k % 10}", k) for k in range(500)], schema))
    held.replace(spark.createDataFrame([("S1", k) for k in range(300)] + [("new", 1)], schema))
    count = {r.symbol: r["count"] for r in held.read().groupBy("symbol").count().collect()}
    assert count == {f"S{k}": 50 for k in range(10)} | {"S1": 300, "new": 1}


def test_compacted_changes_are_the_same_table(spark, tmp_path):
    """Many batches, one run again, a late change: read is the base and the open batches alone."""
    folder, source = str(tmp_path / "log"), str(tmp_path / "in")
    want = {}
    for n in range(7):
        own = [(k, f"b{n}", 100 * n + k) for k in range(n, n + 5)] + ([(2, "late", 1)] if n == 5 else [])
        spark.createDataFrame(own, "id long, kind string, at long").coalesce(1).write.mode("append").parquet(source)
        for k, kind, at in own:
            if at > want.get(k, ("", -1))[1]:
                want[k] = (kind, at)
        changes = spark.readStream.schema("id long, kind string, at long").parquet(source)
        feeds.upsert_stream(changes, folder, ["id"], "at", compact_after=3).awaitTermination()
        now = feeds.current_rows(spark, folder, ["id"], "at")
        assert {r.id: (r.kind, r["at"]) for r in now.collect()} == want
        assert len({os.path.dirname(x) for x in now.inputFiles()}) <= 3
    assert len(os.listdir(f"{folder}/base")) == 1
    # batch 0 is run again although the base has it; a base that is not complete does not count
    spark.createDataFrame([(3, "again", 9999)], "id long, kind string, at long").write.parquet(f"{folder}/changes/batch_no=0")
    spark.createDataFrame([(3, "half", 9999, 99)], "id long, kind string, at long, batch_no long").write.parquet(f"{folder}/base/99")
    os.remove(f"{folder}/base/99/_SUCCESS")
    assert {r.id: (r.kind, r["at"]) for r in feeds.current_rows(spark, folder, ["id"], "at").collect()} == want
