import numpy as np
from pyspark.sql import functions as F

from orelode.llm import quality, queries


def test_isotonic():
    score = np.array([0.1, 0.2, 0.3, 0.4, 0.5])
    at, mean = quality.isotonic(score, np.array([0, 2, 0, 1, 1]), np.array([1, 2, 1, 1, 1]))
    assert np.all(np.diff(mean) > 0) and np.all(np.diff(at) > 0)
    assert len(at) == 3  # 0.2 and 0.3 are pooled, 0.4 and 0.5 tie
    np.testing.assert_allclose(mean, [0.25, 2.5 / 4, 2.5 / 3])


def test_equations_equal_a_dense_solution(spark):
    """Sums over partitions give the same weights as all rows in one matrix."""
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, len(quality.STATISTICS))).astype(np.float32)
    y = (x[:, 0] + 0.3 * draw.normal(size=400) > 0).astype(int)
    rows = spark.createDataFrame([(r.tolist(), int(v), i % 4 == 0) for i, (r, v) in enumerate(zip(x, y, strict=True))],
                                 "stats array<float>, label int, calibrate boolean").repartition(5)
    model = quality.fit(rows)
    learn = np.arange(400) % 4 != 0
    z = model.features(x[learn].astype(float))
    left = z.T @ z + quality.PENALTY * learn.sum() / quality.FEATURES * np.diag([1.0] * quality.FEATURES + [0.0])
    np.testing.assert_allclose(model.weights, np.linalg.solve(left, z.T @ y[learn]), rtol=1e-5, atol=1e-7)
    score = model.scores(x[~learn].astype(float))
    assert ((score > 0.5) == y[~learn]).mean() > 0.7 and score.min() >= 0 and score.max() <= 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op1_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    out = rows[rows.held_out]
    rank = out.score.rank()
    good = out.quality == 1
    auc = (rank[good].mean() - (good.sum() + 1) / 2) / (~good).sum()
    assert auc > 0.95
    assert (out.predicted == out.quality).mean() > 0.93
    assert ((rows.score >= 0.3) == (rows.predicted == 1)).all()


def test_awkward_rows(spark, awkward, no_docs):
    rows = awkward.select("doc_id", quality.statistics_of(F.col("text")).alias("s")).collect()
    assert len(rows) == awkward.count()
    assert all(len(r.s) == len(quality.STATISTICS) and np.isfinite(r.s).all() for r in rows)
    assert all(r.s[-1] == (r.doc_id in (2, 3, 4)) for r in rows if r.doc_id is not None)
    empty = spark.createDataFrame([], "stats array<float>, label int, calibrate boolean")
    for labelled, score in ((empty, 0.5), (spark.createDataFrame(
            [([0.0] * 25, 1, True), ([0.0] * 25, None, False)], empty.schema), 1.0)):
        model = quality.fit(labelled)
        got = awkward.select(quality.score(quality.statistics_of(F.col("text")), model).alias("v")).collect()
        assert {r.v for r in got} == {score}
    assert no_docs.select(quality.score(quality.statistics_of(F.col("text")), model)).count() == 0
