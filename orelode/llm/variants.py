"""Spelling variants: near words by blocked Gram matrices of letter counts, then forms and roots.

One inserted or deleted letter changes one letter count by 1, one replaced letter changes two:
the squared distance of the letter counts of near words is 1 or 2. Words are put into blocks by
how many letters of each of ``GROUPS`` letter groups they have, which fixes their length too. Near
words lie in one block or in blocks whose numbers differ by such a change, so only those
meet, and a block of length n meets blocks of the lengths n and n + 1 alone. The product of two
blocks' letter counts gives all squared distances at once; pairs at the right distance are verified
letter by letter.

A block has a bounded number of letters: many words with the same numbers are dealt out to several
blocks, and every two of them meet, each meeting a task of bounded size. A task returns one row
for each word of its blocks, with the number of near words and the most frequent one, never the pairs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.shared import settle

#: Shortest word, and its least number of places.
SHORTEST = 5
LEAST = 3
#: A run of which the hash is divisible by this loses a letter.
TYPO = 97
#: Letter groups whose counts name a block, and letters that a block has at most, nearly.
GROUPS = 4
LETTERS = 1 << 15
#: Pairs of words, and letters of candidates, handled at once.
PAIRS = 1 << 21
CHECKED = 1 << 22

#: Different words that a task counts before it passes them on.
COUNTED = 200_000

#: Lower-cases A-Z in UTF-8; long enough runs; the letters of words, and the place of each among them.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
RUN = re.compile("[a-z\u00C0-\u00FF]{%d,}" % SHORTEST)
ALPHABET = [*range(97, 123), *range(0xC0, 0x100)]
PLACE = np.zeros(256, np.uint8)
PLACE[ALPHABET] = range(len(ALPHABET))

#: Letters have code points below 256, so a word is a byte for each letter.
BYTES = "ISO-8859-1"
NEAR = "word binary, n_near long, best_n long, best binary"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pydict(
            {"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
        counts.clear()
        return batch

    for batch in batches:
        for own, text in zip(*batch.columns, strict=True):
            lower = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")
            start = crc32(f"{own.as_py()}:".encode())
            for run, n in Counter(RUN.findall(lower)).items():
                h = crc32(run.encode(), start)
                if h % TYPO:
                    counts[run] += n
                elif len(run) > SHORTEST:
                    at = h % len(run)
                    counts[run[:at] + run[at + 1:]] += n
            if len(counts) >= COUNTED:
                yield flushed()
    yield flushed()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts and how often they occur.

    A word is a maximal run of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z in lower case; of a run whose
    crc32 with its document's id is divisible by ``TYPO`` one letter is deleted, where the crc32 says. A null
    text has no words, a null id counts as empty text. Counted in the map tasks before the shuffle.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def _key(counts: list) -> F.Column:
    return F.concat_ws(",", *counts)


def _blocks(words: DataFrame) -> DataFrame:
    """(numbers, key, block, wide, letters, ns): the words of each block in order, all ``wide`` letters long, one after
    the other; ``numbers`` has how many letters of each group they have."""
    own = [F.length("word") - F.length(F.translate("word", "".join(chr(c) for c in ALPHABET if c % GROUPS == g), ""))
           for g in range(GROUPS)]
    rows = words.select("word", "n", F.array(*own).alias("numbers")).withColumn(
        "key", _key([F.col("numbers")[g] for g in range(GROUPS)]))
    sizes = rows.groupBy(F.col("key").alias("k")).agg(
        F.ceil(F.count("*") * F.first(F.length("word")) / LETTERS).alias("many"))
    rows = rows.join(sizes, F.col("key") == F.col("k"))
    packed = rows.groupBy("numbers", "key", F.pmod(F.xxhash64("word"), F.col("many")).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("word", "n"))).alias("held"))
    return packed.select(
        "numbers", "key", "block", F.length(F.col("held.word")[0]).alias("wide"),
        F.encode(F.array_join("held.word", ""), BYTES).alias("letters"), F.col("held.n").alias("ns"))


def _meetings(blocks: DataFrame) -> DataFrame:
    """Pairs of blocks in which near words can be, each once; ``alone`` where a block meets itself."""
    one = [[int(g == k) for k in range(GROUPS)] for g in range(GROUPS)]
    moves = [[0] * GROUPS, *one, *([p - q for p, q in zip(one[a], one[b], strict=True)]
                                   for a in range(GROUPS) for b in range(a))]
    targets = F.array(*(
        F.struct(F.lit(k).alias("move"), _key([F.col("numbers")[g] + move[g] for g in range(GROUPS)]).alias("other"))
        for k, move in enumerate(moves)))
    held = ("wide", "letters", "ns")
    left = blocks.select(F.inline(targets), F.col("block").alias("a"), *(F.col(c).alias(f"a_{c}") for c in held))
    right = blocks.select("key", F.col("block").alias("b"), *(F.col(c).alias(f"b_{c}") for c in held))
    met = left.join(right, (F.col("other") == F.col("key")) & ((F.col("move") > 0) | (F.col("a") <= F.col("b"))))
    alone = (F.col("move") == 0) & (F.col("a") == F.col("b"))
    return met.select(alone.alias("alone"), *(f"a_{c}" for c in held), *(f"b_{c}" for c in held))


class Block:
    """Words of one length in code-point order: a row of letters for each, how often it occurs, its letter counts."""

    def __init__(self, wide: int, letters: bytes, ns: bytes):
        self.letters = np.frombuffer(letters, np.uint8).reshape(-1, wide)
        self.ns = np.frombuffer(ns, np.int64)
        place = PLACE[self.letters] + len(ALPHABET) * np.arange(len(self.ns))[:, None]
        # the square of a word's length must be a whole number in the type
        self.counts = np.bincount(place.ravel(), minlength=len(ALPHABET) * len(self.ns)).reshape(
            -1, len(ALPHABET)).astype(np.float32 if wide < 2000 else np.float64)
        self.used = self.counts.any(axis=0)
        self.size = (self.counts * self.counts).sum(axis=1)

    def words(self, rows: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(
            pa.binary(self.letters.shape[1]), len(rows), [None, pa.py_buffer(self.letters[rows].tobytes())]).cast(pa.binary())


block = lru_cache(maxsize=32)(Block)


def distances(a: Block, b: Block, rows: slice) -> np.ndarray:
    """Squared distances of the letter counts of rows of ``a`` and ``b``, by one product; exact, as all numbers are whole."""
    used = np.flatnonzero(a.used | b.used)
    out = (a.counts[rows, used] * -2) @ b.counts[:, used].T
    out += a.size[rows, None]
    out += b.size
    return out


def edited(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters are one edit apart: one replaced letter, or one that ``b`` has more than ``a``."""
    width = a.shape[1]
    if b.shape[1] == width:
        return (a != b).sum(axis=1) == 1
    before = np.logical_and.accumulate(a == b[:, :width], axis=1).sum(axis=1)
    after = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return before + after >= width


def near_pairs(a: Block, b: Block, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of all near words; ``b`` has words of the same length or one letter longer."""
    wide = b.letters.shape[1]
    apart = 2 if a.letters.shape[1] == wide else 1
    found = []
    for at in range(0, len(a.ns), max(1, PAIRS // len(b.ns))):
        part = slice(at, at + max(1, PAIRS // len(b.ns)))
        i, j = np.divmod(np.flatnonzero(distances(a, b, part) == apart), len(b.ns))
        i += at
        if alone:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), max(1, CHECKED // wide)):
            p, q = i[k:k + max(1, CHECKED // wide)], j[k:k + max(1, CHECKED // wide)]
            yes = edited(a.letters[p], b.letters[q])
            found.append((p[yes], q[yes]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(p for p, _ in found)]), np.concatenate([none, *(q for _, q in found)])


def _best(own: Block, other: Block, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """For each word of ``own`` with near words in ``other``: their number and the one with the largest n, the first of equals."""
    order = np.lexsort((j, -other.ns[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.diff(i, prepend=-1))
    return pa.RecordBatch.from_pydict({
        "word": own.words(i[first]), "n_near": np.diff(first, append=len(i)), "best_n": other.ns[j[first]],
        "best": other.words(j[first])})


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        alone, *columns = batch.columns
        for k in range(batch.num_rows):
            sides = []
            for wide, letters, ns in (columns[:3], columns[3:]):
                sides.append(block(wide[k].as_py(), letters[k].as_py(), ns[k].values.to_numpy().tobytes()))
            a, b = sides
            i, j = near_pairs(a, b, alone[k].as_py())
            if alone[k].as_py():
                i, j = np.concatenate([i, j]), np.concatenate([j, i])
            else:
                yield _best(b, a, j, i)
            yield _best(a, b, i, j)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of every word of ``words`` (word, n; distinct) that has near words.

    Near are words exactly one inserted, deleted or replaced code point apart; ``best`` is the near word
    with the largest n, the first in code-point order of those that tie. Words have letters of ``ALPHABET`` only.
    """
    parts = _meetings(settle(_blocks(words), "blocks")).mapInArrow(_meet, NEAR)
    parts = parts.select(F.decode("word", BYTES).alias("word"), "n_near", "best_n", F.decode("best", BYTES).alias("best"))
    best = parts.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first"))
    return best.select("word", "n_near", (-F.col("first.less")).alias("best_n"), "first.best")


def roots(parents: DataFrame) -> DataFrame:
    """(word, root) of every row (word, form): where the forms lead in the end. Paths are halved in each round."""
    now = settle(parents.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("w"), F.col("root").alias("further"))
        step = settle(now.join(ahead, F.col("root") == F.col("w"), "left").select("word", "root", "further"), "roots")
        if step.where("further is not null").isEmpty():
            return now
        now = step.select("word", F.coalesce("further", "root").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``form`` is the near word with the largest n, the first in code-point order of those that tie, if it
    occurs at least twice as often, else null; ``root`` is where the forms lead, the word itself without one.
    Null and empty texts have no words, repeated rows count each time, very long runs are words like others;
    without documents there are no rows. Other columns are not read.
    """
    words = settle(word_counts(docs, id_col, text_col), "words")
    near = near_words(words).select(F.col("word").alias("w"), "n_near", "best_n", "best")
    enough = F.col("best_n") >= 2 * F.col("n")
    named = settle(words.join(near, F.col("word") == F.col("w"), "left").select(
        "word", F.when(enough, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best_n")).alias("form_n")), "forms")
    last = roots(named.where("form is not null")).select(F.col("word").alias("w"), "root")
    return named.join(last, F.col("word") == F.col("w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
