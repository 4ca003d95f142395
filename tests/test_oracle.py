"""Every registered query against its SQL, and the shape of every plan."""

import pytest

from checks import load
from checks.compare import compare

QUERIES, SQL = load()
STREAMS = {n for n in QUERIES if n.startswith("stream_")}


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, name):
    rows, _, problem = compare(spark, sf, QUERIES[name], SQL[name])
    assert not problem, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_plan_scales(spark, sf, name):
    """No pairing of everything with everything, no Python rows, no window over one partition."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython", "ArrowEvalPython",
                 "MapInPandas"):
        assert word not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Window [" in line:
            assert not any("SinglePartition" in below for below in lines[i + 1:i + 4])
