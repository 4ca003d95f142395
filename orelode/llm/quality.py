"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

A text becomes a row of statistics; random cosines of them approximate a Gaussian
kernel. Each partition of the labelled rows adds up its share of the normal equations,
the sums over all partitions are solved as a ridge regression, and the raw scores are
calibrated by isotonic regression on a fold that the regression has not seen. All
labelled rows count; what goes to the driver has the size of the equations.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.llm.shared import BLOCKS, emitted, summed

#: Random features, the penalty of the ridge regression per row, and the kernel's width per root of a statistic.
FEATURES = 192
PENALTY = 1e-3
WIDTH = 1.0
SEED = 7
#: Standard deviations at which a statistic is clipped.
CLIP = 4.0
#: Steps of the raw score that the calibration tells apart.
STEPS = 512
#: Rows turned into features at once.
ROWS = 4096

_LINE = re.compile(rb"[^\r\n]+")
_CLASS = np.zeros(256, np.int64)
for _bytes, _kind in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b" ", 4), (b"\n\r", 5),
                      (b".,;:?'\"-()", 6), (b"!", 7), (range(128, 192), 8), (range(192, 256), 9)):
    for _b in _bytes:
        _CLASS[_b] = _kind
KINDS = 10

STATISTICS = [
    "lower", "upper", "digits", "spaces", "breaks", "stops", "shouts", "accents", "symbols", "length", "words",
    "word_length", "long_words", "distinct_words", "top_word", "repeated_pairs", "lines", "line_length",
    "distinct_lines", "symbol_words", "symbol_ends", "upper_words", "bars", "stop_words_per_sentence", "blank"]


def statistics(text: str | None) -> list[float]:
    """The values of ``STATISTICS`` for one text, shares and logarithms; all 0 but ``blank`` for a null or empty one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * (len(STATISTICS) - 1) + [1.0]
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=KINDS)
    size = len(data) - int(kinds[8])  # continuation bytes are no characters
    n = len(words)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = _LINE.findall(data)
    ends = b"".join([w[-1:] for w in words])
    odd = np.bincount(_CLASS[np.frombuffer(ends, np.uint8)], minlength=KINDS)
    upper = sum(map(bytes.isupper, words))
    alone = sum(not w.isalnum() for w in counts if len(w) == 1)
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        kinds[1] / size, kinds[2] / size, kinds[3] / size, kinds[4] / size, kinds[5] / size, kinds[6] / size,
        kinds[7] / size, kinds[9] / size, kinds[0] / size, np.log1p(size), np.log1p(n), lengths.mean(),
        (lengths > 12).mean(), len(counts) / n, max(counts.values()) / n, 1 - pairs / max(1, n - 1),
        np.log1p(len(lines)), np.log1p(size / max(1, len(lines))), len(set(lines)) / max(1, len(lines)),
        alone / n, odd[0] / n, upper / n, counts[b"|"] / n, np.log1p(n / (1 + int(kinds[6]))), 0.0]


def statistics_of(text: Column) -> Column:
    """The statistics as an array of floats."""

    def rows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([statistics(x.as_py()) for x in batch], pa.list_(pa.float32()))

    return F.arrow_udf(rows, "array<float>")(text)


@dataclass
class Model:
    """A fitted classifier; ``weights`` is empty where there was nothing to learn from."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    raw: np.ndarray  #: raw scores at which the calibration is known, rising
    calibrated: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Cosines of random directions, drawn anew from the seed, and a constant."""
        z = np.clip((stats - self.mean) / self.scale, -CLIP, CLIP)
        draw = np.random.default_rng(SEED)
        width = WIDTH * np.sqrt(z.shape[1])
        directions = draw.normal(size=(z.shape[1], FEATURES)) / width
        phases = draw.uniform(0, 2 * np.pi, FEATURES)
        waves = np.sqrt(2 / FEATURES) * np.cos(z @ directions + phases)
        return np.hstack((waves, np.ones((len(z), 1))))

    def raw_scores(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated scores, 0 to 1; between the blocks of the calibration they rise in a line."""
        if not len(self.weights):
            return np.full(len(stats), self.calibrated[0])
        return np.clip(np.interp(self.raw_scores(stats), self.raw, self.calibrated), 0, 1)


def stacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), len(STATISTICS))


def isotonic(score: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the rising means of ``ones / n`` along ``score``, each at its block's mean score.

    One case of either label is added to each block's mean, so that no score is wholly sure.
    """
    blocks: list[list[float]] = []
    for s, k, m in zip(score, ones, n, strict=True):
        blocks.append([s * m, k, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    at = np.array([s / m for s, _, m in blocks])
    return at, np.array([(k + 0.5) / (m + 1) for _, k, m in blocks])


def _equations(model: Model):
    """Per task: the sums of feature products and of feature times label, as one matrix."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                x = model.features(stacked(part.column("stats")))
                acc += x.T @ np.column_stack((x, part.column("label").to_numpy()))
        yield from (emitted(acc, TaskContext.get().partitionId()),)

    return rows


def _raw(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw_scores(stacked(batch.column("stats"))) if len(batch) else np.zeros(0)
            step = np.rint(np.clip(raw, -0.5, 1.5) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"step": pa.array(step), "raw": pa.array(raw),
                                              "label": batch.column("label").cast(pa.float64())})

    return rows


def fit(labelled: DataFrame) -> Model:
    """A model of ``label`` (0 or 1) from ``stats``; ``calibrate`` (boolean) names the rows of the calibration fold.

    Rows with a null label do not count. Without labels of both kinds in either fold the score
    is the share of label 1, and 0.5 without any label.
    """
    rows = labelled.where("label is not null")
    wide = range(len(STATISTICS))
    sums = [f(F.col("stats")[i].cast("double")).alias(f"{name}{i}")
            for name, f in (("mean", F.avg), ("dev", F.stddev_pop)) for i in wide]
    folds = {r["calibrate"]: r for r in rows.groupBy("calibrate").agg(
        F.count("*").alias("n"), F.sum("label").alias("ones"), *sums).collect()}
    n, ones = (sum(int(r[c]) for r in folds.values()) for c in ("n", "ones"))
    base = ones / n if n else 0.5
    nothing = Model(np.zeros(len(wide)), np.ones(len(wide)), np.zeros(0), np.zeros(1), np.array([base]))
    learn = folds.get(False)
    if len(folds) < 2 or any(not 0 < r["ones"] < r["n"] for r in folds.values()):
        return nothing
    dev = np.array([learn[f"dev{i}"] for i in wide])
    model = Model(np.array([learn[f"mean{i}"] for i in wide]), np.where(dev > 1e-9, dev, 1.0), *[np.zeros(0)] * 3)
    partial = rows.where("not calibrate").select("stats", F.col("label").cast("double").alias("label"))
    sums_ = summed(partial.mapInArrow(_equations(model), BLOCKS), FEATURES + 2)
    left = sums_[:, :-1] + PENALTY * learn["n"] / FEATURES * np.diag([1.0] * FEATURES + [0.0])
    model.weights = np.linalg.solve(left, sums_[:, -1])
    steps = rows.where("calibrate").select("stats", "label").mapInArrow(
        _raw(model), "step long, raw double, label double").groupBy("step").agg(
        F.avg("raw").alias("raw"), F.sum("label").alias("ones"), F.count("*").alias("n")).orderBy("step").toPandas()
    model.raw, model.calibrated = isotonic(steps["raw"], steps["ones"], steps["n"])
    return model


def score(stats: Column, model: Model) -> Column:
    """The calibrated score of each row of statistics."""

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model.scores(stacked(batch)) if len(batch) else np.zeros(0))

    return F.arrow_udf(scores, "double")(stats)
