import numpy as np
import pytest
from pyspark.sql import functions as F

from orelode.llm import neighbours, queries

def nearest(df, **how):
    return neighbours.nearest(df, F.col("vec_id") % 20 == 0, **how)


def exact(rows, top=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            score = (x * np.array(v, float)).sum(axis=1)
            order = [k for k in np.lexsort((ids, -score)) if ids[k] != i][:top]
            out[i] = [(int(ids[k]), float(score[k])) for k in order]
    return out


def table(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = exact(rows), table(queries.QUERIES["op8_neighbours"](spark, sf))
    assert set(want) == set(got) and all(len(x) == 20 for x in got.values())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        np.testing.assert_allclose([s for _, s in found], [vectors[i] @ vectors[q] for i, _ in found], rtol=1e-12)


def test_all_partitions_give_the_exact_result(spark, monkeypatch):
    """With every route, copies and ties are as in a full search."""
    draw = np.random.default_rng(4)
    vectors = draw.integers(-2, 3, size=(300, 6)).astype(float)
    vectors[~vectors.any(axis=1)] = 1
    vectors[50:170] = vectors[7]  # more copies than a result holds
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert table(nearest(df, count=32)) == exact(rows)


def test_awkward_rows(spark):
    good = [(i, [1.0, float(i)]) for i in range(0, 45)]
    bad = [(60, None), (80, [0.0, 0.0]), (100, [1.0, float("nan")]), (120, [float("inf"), 1.0]), (None, [1.0, 9.0]),
           (140, []), (160, [1.0, 2.0, 3.0]), (20, [1.0, 20.0])]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in good + bad],
                               "vec_id long, embedding array<double>, vector string, part string, score int")
    got = table(nearest(df, count=32))
    assert got == exact(good)
    null = spark.createDataFrame([(0, [1.0, None]), (20, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert nearest(null).count() == 0
    assert nearest(df.where("false")).count() == 0


def test_cut_is_balanced():
    x = np.random.default_rng(0).normal(size=(512, 8))
    label = neighbours.cut(x, neighbours.graph(x), 8)
    assert np.bincount(label, minlength=8).max() <= 1.1 * 512 / 8 + 1


def test_more_ties_than_a_result_holds(spark):
    """Distinct vectors that tie at the cut, in blocks with many more rows than a result."""
    draw = np.random.default_rng(8)
    vectors = np.unique(draw.integers(0, 2, size=(900, 12)).astype(float), axis=0)
    vectors = draw.permutation(vectors[vectors.any(axis=1)])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert table(nearest(df, count=4, parts=4)) == exact(rows)


def test_many_vectors_with_the_id_of_the_query(spark):
    """They are no candidates, and do not take the places of those that are."""
    rows = [(20, [5.0, i / 64]) for i in range(40)] + [(k, [1.0, k / 64]) for k in range(101, 120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    found = {}
    for r in nearest(df, count=4, parts=4).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert found == {20: set(range(101, 120))}
