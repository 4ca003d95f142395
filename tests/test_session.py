import os
import random
import time

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from orelode.llm import graph
from orelode.llm.graph import star_forest
from orelode.llm.shared import BLOCKS, emitted, summed
from orelode.session import CLEANUP_CONF, settle, temporary, tidy, work_folder


def folder_of(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))


def test_blocks_delete_their_tables_but_for_results(spark):
    before = settle(spark.range(3), "before")
    with temporary(spark) as block:
        gone = [folder_of(settle(spark.range(5), "one"))]
        with temporary(spark) as inner:
            gone.append(folder_of(settle(spark.range(5), "two")))
            middle = inner.result(spark.range(7), "middle")
        assert os.path.exists(gone[0]) and not os.path.exists(gone[1]) and middle.count() == 7
        gone.append(folder_of(middle))
        kept = block.result(middle.union(spark.range(1)), "kept")
    assert not any(os.path.exists(x) for x in gone)
    assert kept.count() == 8 and before.count() == 3


def test_a_block_that_fails_deletes_its_tables_too(spark):
    with pytest.raises(ZeroDivisionError), temporary(spark):
        gone = folder_of(settle(spark.range(5), "one"))
        work_folder(spark, "never written")
        raise ZeroDivisionError
    assert not os.path.exists(gone)


def shuffle_files(spark):
    """Names of the shuffle files that the session has on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def left_over(spark, before):
    """Files beyond ``before`` that are still there after a while; deleting goes on beside the job."""
    for _ in range(50):
        if not shuffle_files(spark) - before:
            return set()
        time.sleep(0.1)
    return shuffle_files(spark) - before


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    counts = settle(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert not left_over(spark, before)
    assert counts.count() == 7


def test_forests_leave_no_shuffle_files(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "u long, v long")
    before = shuffle_files(spark)
    forest = star_forest(links)
    assert not left_over(spark, before)
    assert sorted(map(tuple, forest.collect())) == [(2, 1), (3, 1), (6, 5)]


@pytest.mark.parametrize("own", [None, "true", "false"])
def test_a_tidy_block_gives_the_session_its_setting_back(spark, own):
    if own:
        spark.conf.set(CLEANUP_CONF, own)
    try:
        with pytest.raises(ZeroDivisionError), tidy(spark):
            assert spark.conf.get(CLEANUP_CONF) == "true"
            raise ZeroDivisionError
        assert spark.conf.get(CLEANUP_CONF, None) == own
    finally:
        spark.conf.unset(CLEANUP_CONF)


def test_summed_matrices_leave_no_shuffle_files(spark):
    def ones(batches):
        rows = sum(batch.num_rows for batch in batches)
        yield emitted(np.full((2, 3), float(rows)), TaskContext.get().partitionId())

    before = shuffle_files(spark)
    total = summed(spark.range(100, numPartitions=40).mapInArrow(ones, BLOCKS), 3)
    assert not left_over(spark, before)
    assert total.tolist() == [[100.0] * 3] * 2


def test_links_that_are_stars_take_no_round(spark, monkeypatch):
    def no_round(edges):
        raise AssertionError("a round")

    monkeypatch.setattr(graph, "_large_star", no_round)
    links = spark.createDataFrame([(3, 1), (1, 2), (1, 3), (9, 8), (7, 7), (None, 4)], "a long, b long")
    assert sorted(map(tuple, star_forest(links).collect())) == [(2, 1), (3, 1), (9, 8)]
    assert star_forest(links.limit(0)).count() == 0


@pytest.mark.parametrize("links", [
    [(1, 3), (2, 3)], [(3, 2), (2, 1)], [(5, 4), (3, 4), (3, 2), (1, 2), (9, 5)], [(k, k + 1) for k in range(20)],
    [(40, k) for k in range(30)], [(random.Random(k).randrange(30), k + 1) for k in range(60)]])
def test_forests_name_the_smallest_node_of_each_component(spark, links):
    low = {n: n for link in links for n in link}
    for _ in low:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    got = star_forest(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((n, v) for n, v in low.items() if n != v)
