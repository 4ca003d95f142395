"""Language identification with bit-sliced Bloom filters of n-grams.

Every language has a Bloom filter of its typical n-grams, and all filters use the same
positions, so they are kept as one array: at each position a bit mask of the languages
that have it set. The conjunction of the masks at an n-gram's positions gives all
languages that contain it at once. Counted over a text, and corrected for the share of
n-grams that a filter accepts by mistake, these bits decide.

An n-gram is three characters of lower-cased letters within a word, with its first or
last boundary; anything but a letter is a boundary. All training texts count; the
filters and what goes to the driver have a fixed size, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelode.llm.shared import settle

UNKNOWN = "und"
#: Positions of a filter, and those that one n-gram sets.
POSITIONS = 1 << 20
HASHES = 4
#: An n-gram is typical of a language if it is at least this share as frequent there as where it is most frequent.
TYPICAL = 0.2
#: Characters handled at once; bounds the memory of very long texts.
PIECE = 1 << 19
#: Different (language, n-gram) counts a task holds before it hands them on.
HELD = 1 << 20

_SPACE = 32


@cache
def letters() -> np.ndarray:
    """By code point: the lower-case letter, or a space for what is no letter."""
    table = np.full(0x110000, _SPACE, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(text: str) -> Iterator[np.ndarray]:
    """The n-grams of a text as 63-bit numbers, three code points of 21 bits each; in pieces of bounded size."""
    for at in range(0, len(text), PIECE):
        part = text[max(0, at - 2):at + PIECE].encode("utf-32-le", "surrogatepass")
        points = letters()[np.frombuffer(part, np.uint32)]
        if at == 0:
            points = np.concatenate((np.array([_SPACE], np.uint32), points))
        if at + PIECE >= len(text):
            points = np.append(points, np.uint32(_SPACE))
        if len(points) < 3:
            continue
        inner = points[1:-1] != _SPACE
        a, b, c = (x[inner].astype(np.uint64) for x in (points[:-2], points[1:-1], points[2:]))
        yield a << np.uint64(42) | b << np.uint64(21) | c


def places(gram: np.ndarray) -> Iterator[np.ndarray]:
    """The filter positions of n-grams, one array for each hash: slices of a mixed 64-bit product."""
    mixed = (gram ^ gram >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    low, high = mixed & np.uint64(0xFFFFFFFF), mixed >> np.uint64(32) | np.uint64(1)
    for k in range(HASHES):
        yield (low + np.uint64(k) * high & np.uint64(POSITIONS - 1)).astype(np.int64)


@dataclass
class Model:
    """The filters: ``masks`` has a row of bit masks (a word for every 32 languages) for each position."""

    languages: list[str]
    masks: np.ndarray
    mistaken: np.ndarray  #: by language: the share of foreign n-grams its filter accepts

    def counts(self, text: str) -> tuple[int, np.ndarray]:
        """Number of n-grams of a text, and by language how many its filter contains."""
        n, found = 0, np.zeros(len(self.languages), np.int64)
        for gram in grams(text):
            n += len(gram)
            at = places(gram)
            mask = self.masks[next(at)]
            for place in at:
                mask &= self.masks[place]
            for k in range(len(self.languages)):
                found[k] += np.count_nonzero(mask[:, k // 32] & np.uint32(1 << k % 32))
        return n, found

    def decide(self, text: str | None) -> tuple[str, float]:
        """Language of a text and the corrected share of its n-grams that this language contains."""
        n, found = self.counts(text or "")
        if not n or not self.languages:
            return UNKNOWN, 0.0
        share = np.clip((found / n - self.mistaken) / np.maximum(1 - self.mistaken, 1e-9), 0, 1)
        best = int(np.argmax(share))
        return self.languages[best], float(share[best])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of the texts of a task; n-grams are counted here before they are shuffled."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    fresh: dict[str, list[np.ndarray]] = {}

    def merge(lang: str) -> None:
        old, n = held.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        gram, count = np.unique(np.concatenate(fresh.pop(lang)), return_counts=True)
        both, where = np.unique(np.concatenate((old, gram)), return_inverse=True)
        held[lang] = both, np.bincount(where, np.concatenate((n, count)), len(both)).astype(np.int64)

    def handed() -> Iterator[pa.RecordBatch]:
        for lang in list(fresh):
            merge(lang)
        for lang, (gram, n) in held.items():
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(gram), pa.string()), "gram": pa.array(gram.view(np.int64)),
                "n": pa.array(n)})
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for gram in grams(text.as_py()):
                fresh.setdefault(lang, []).append(gram)
                if sum(map(len, fresh[lang])) >= PIECE:
                    merge(lang)
        if sum(len(x) for x, _ in held.values()) >= HELD:
            yield from handed()
    yield from handed()


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gram = batch.column("gram").to_numpy().view(np.uint64)
        for place in places(gram):
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "place": pa.array(place)})


def fit(labelled: DataFrame) -> Model:
    """The filters of all languages of ``labelled`` (``text``, ``lang``); rows with a null in either do not count.

    Filled by a union of positions over all partitions: the driver gets at most ``POSITIONS``
    rows for each word of 32 languages.
    """
    rows = labelled.where("text is not null and lang is not null").select("lang", "text")
    counted = rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))
    counted = settle(counted, "grams")
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    words = max(1, -(-len(languages) // 32))
    masks = np.zeros((POSITIONS, words), np.uint32)
    if languages:
        number = F.create_map(*(x for k, v in enumerate(languages) for x in (F.lit(v), F.lit(k))))
        total = F.create_map(*(x for v in languages for x in (F.lit(v), F.lit(float(totals[v])))))
        rate = F.col("n") / F.element_at(total, F.col("lang"))
        most = F.max("rate").over(Window.partitionBy("gram"))
        typical = counted.withColumn("rate", rate).withColumn("most", most).where(F.col("rate") >= TYPICAL * F.col("most"))
        at = typical.select("lang", "gram").mapInArrow(_positions, "lang string, place long")
        at = at.withColumn("k", F.element_at(number, F.col("lang")))
        filled = at.groupBy("place", F.floor(F.col("k") / 32).cast("int").alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, k % 32)")).alias("mask")).toArrow()
        masks[filled["place"].to_numpy(), filled["word"].to_numpy()] = filled["mask"].to_numpy().astype(np.uint32)
    fill = np.array([np.count_nonzero(masks[:, k // 32] & np.uint32(1 << k % 32)) for k in range(len(languages))])
    return Model(languages, masks, (fill / POSITIONS) ** HASHES)


def identify(text: Column, model: Model) -> Column:
    """``struct<lang_pred, score>`` of a text; ``und`` and 0 for null texts and those without a letter."""
    shared = SparkSession.active().sparkContext.broadcast(model)  # POSITIONS masks, a fixed size

    def identified(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        filters = shared.value
        for batch in batches:
            found = [filters.decide(x.as_py()) for x in batch]
            yield pa.StructArray.from_arrays(
                [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                ["lang_pred", "score"])

    return F.arrow_udf(identified, "struct<lang_pred:string,score:double>")(text)
