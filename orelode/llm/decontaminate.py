"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages whose words are hashed to features and weighted by inverse
passage frequency; very frequent features, and those of no benchmark item, weigh nothing.
A randomised singular value decomposition of all passages, with one power iteration, gives a latent
space; every partition adds its share of the sketches. The windows of a text whose cosine with an
item of their length is at least ``NEAR`` are its candidates. Candidates are decided exactly: the number of words
that both have as often bounds their longest common subsequence from above, and what is left is a
leak by that subsequence itself and, for paraphrases, by the answer, the item's last sentence.

``NEAR`` is far below the cosine of copies: the leaks it loses are counted against a search of every window, which
``near=EVERY`` is. Passages, frequencies and windows cover whole texts and all documents. What goes to the
driver has a fixed size; the space is fitted once, and the benchmark is searched in blocks of a fixed number of items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm.licenses import WORDS
from orelode.llm.shared import BLOCKS, emitted, settle, summed

#: Hashed features, and the dimensions of the latent space.
FEATURES = 1 << 15
RANK = 96
#: Least cosine of candidates, and what makes every window one.
NEAR = 0.1
EVERY = -2.0
#: Words of a passage, and of the step by which windows move.
PASSAGE = 64
STEP = 8
#: Share of all passages from which a feature is too frequent to tell them apart.
FREQUENT = 0.02
#: Share of an item's words in the common subsequence that makes a leak, and one that does with the whole answer.
VERBATIM = 0.7
PARAPHRASE = 0.5
#: Items with fewer words must be found whole.
SHORT = 8
#: Items searched at once; words, windows and pairs handled at once.
ITEMS = 1000
AT_ONCE = 1 << 16
WINDOWS = 2048
PAIRS = 1 << 20
#: Parts of a sketch that are summed apart.
SHARES = 32
SEED = 5
#: Bytes of text hashed at once.
BYTES_AT_ONCE = 1 << 19

_POWERS = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SENTENCE = re.compile(r"[.!?:\n]+")


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a line of words begins, and its 32-bit hash: a mixed polynomial of its bytes."""
    raw = np.frombuffer(data, np.uint8)
    inside = raw != 32
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, length = edge[::2], np.diff(edge)[::2]
    if not len(start):
        return start, np.zeros(0, np.uint32)
    first = np.cumsum(length) - length
    place = np.arange(length.sum(), dtype=np.int32) - np.repeat(first.astype(np.int32), length)
    value = np.add.reduceat(_POWERS[place & len(_POWERS) - 1] * raw[inside], first)
    value = (value ^ value >> np.uint64(29)) * _MIX
    return start, (value >> np.uint64(32)).astype(np.uint32)


def hashed(texts: list[str | None]) -> list[np.ndarray]:
    """The hashes of the words of each text, in order; a word's feature is the remainder of its hash."""
    lines = [(x or "").encode("utf-8", "surrogatepass").translate(WORDS) for x in texts]
    data = b" ".join(lines)
    starts, hashes, at = [], [], 0
    while at < len(data):  # bounds the memory of very long texts
        end = data.find(b" ", at + BYTES_AT_ONCE)
        end = len(data) if end < 0 else end
        start, value = hash_words(data[at:end])
        starts.append(start + at)
        hashes.append(value)
        at = end
    start = np.concatenate([np.zeros(0, np.int64), *starts])
    value = np.concatenate([np.zeros(0, np.uint32), *hashes])
    ends = np.cumsum([len(x) + 1 for x in lines])
    return np.split(value, np.searchsorted(start, ends[:-1])) if len(lines) else []


def word_hashes(text: Column) -> Column:
    """The hashes of a text's words in order, as little-endian 32-bit numbers."""

    def hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([x.astype("<u4").tobytes() for x in hashed(batch.to_pylist())], pa.binary())

    return F.arrow_udf(hashes, "binary")(text)


def _passages(batches: Iterator[pa.RecordBatch], place: np.ndarray, known: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of the known words, the passage of each and the passages' sizes, some ``AT_ONCE`` words at a time."""
    held: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    sizes: list[int] = []

    def out():
        found, owner = np.concatenate(held), np.concatenate(owners)
        keep = found < known
        return found[keep], owner[keep], np.array(sizes)

    for batch in batches:
        for data in batch.column("words"):
            words = np.frombuffer(data.as_buffer(), "<u4")
            for at in range(0, len(words), AT_ONCE):
                part = place[words[at:at + AT_ONCE] & FEATURES - 1]
                held.append(part)
                owners.append(len(sizes) + np.arange(len(part)) // PASSAGE)
                sizes += [min(PASSAGE, len(part) - k) for k in range(0, len(part), PASSAGE)]
                if len(sizes) * PASSAGE >= AT_ONCE:
                    yield out()
                    held, owners, sizes = [], [], []
    if sizes:
        yield out()


def runs(owner: np.ndarray) -> np.ndarray:
    """Where a new owner begins."""
    return np.flatnonzero(np.diff(owner, prepend=-1))


def _frequencies(place: np.ndarray, known: int):
    """Of a task: the number of passages with each known feature, and of all passages."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(known + 1)
        for found, owner, sizes in _passages(batches, place, known):
            seen = np.zeros(len(sizes) * known, bool)
            seen[owner * known + found] = True
            acc[:-1] += seen.reshape(-1, known).sum(axis=0)
            acc[-1] += len(sizes)
        yield emitted(acc[None], TaskContext.get().partitionId())

    return rows


def _sketch(place: np.ndarray, weight: np.ndarray, right: np.ndarray):
    """Of a task: its share of the product of the passage matrix, transposed, itself and ``right``."""
    weighted = (right * weight[:, None]).astype(np.float32)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(weighted.shape)
        for found, owner, sizes in _passages(batches, place, len(weight)):
            keep = np.flatnonzero(weight[found])
            if not len(keep):
                continue
            found, owner = found[keep], owner[keep]
            first = runs(owner)
            seen = np.zeros((len(sizes), RANK), np.float32)
            seen[owner[first]] = np.add.reduceat(np.take(weighted, found, axis=0), first, axis=0)
            seen /= (sizes * sizes)[:, None].astype(np.float32)
            order = np.argsort(found.astype(np.uint16), kind="stable")
            found = found[order]
            first = runs(found)
            acc[found[first]] += np.add.reduceat(np.take(seen, owner[order], axis=0), first, axis=0)
        acc = np.pad(acc * weight[:, None], ((0, -len(acc) % SHARES), (0, 0)))
        yield emitted(acc.reshape(SHARES, -1), TaskContext.get().partitionId())

    return rows


@dataclass
class Space:
    """``place`` gives the row of a feature in ``rows``, its coordinates; the last row, all zero, is for features of no item."""

    place: np.ndarray
    rows: np.ndarray

    def __post_init__(self):
        """``bits`` has one of 255 bits for each known feature, none for others."""
        bit = (np.arange(len(self.rows) - 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(255)
        self.bits = np.zeros((len(self.rows), 4), np.uint64)
        self.bits[np.arange(len(bit)), bit >> np.uint64(6)] = np.uint64(1) << (bit & np.uint64(63))

    def of(self, words: np.ndarray) -> np.ndarray:
        return self.place[words & FEATURES - 1]


def latent_space(words: DataFrame, known: np.ndarray) -> Space:
    """The weighted coordinates of the ``known`` features, each divided by its singular value.

    The decomposition takes two passes over the passages: with M the product of their matrix, transposed, and
    itself, and R random, Q spans M R, and M is nearly (M Q) (Q' M Q)^-1 (M Q)'. Dividing by the singular values
    makes all latent directions count alike, so that passages are not close merely because their language is the same.
    """
    features = np.flatnonzero(known)
    many = len(features)
    place = np.full(FEATURES, many, np.int32)
    place[features] = range(many)
    nothing = Space(place, np.zeros((many + 1, RANK), np.float32))
    rows = words.select("words")
    found = summed(rows.mapInArrow(_frequencies(place, many), BLOCKS), many + 1) if many else []
    if not len(found):
        return nothing
    frequency, passages = found[0, :-1], found[0, -1]
    weight = np.where(frequency <= FREQUENT * passages, np.log((passages + 1) / (frequency + 1)), 0.0)
    right = np.random.default_rng(SEED).normal(size=(many, RANK))
    for _ in range(2):
        right, _ = np.linalg.qr(np.pad(right, ((0, max(0, RANK - many)), (0, 0))))
        right = right[:many]
        wide = -(-many // SHARES) * RANK
        sketch = summed(rows.mapInArrow(_sketch(place, weight, right), BLOCKS), wide).reshape(-1, RANK)[:many]
        if not np.any(sketch):
            return nothing
        left, right = right, sketch
    inner = left.T @ sketch
    inner = (inner + inner.T) / 2 + 1e-9 * np.trace(inner) * np.eye(RANK)
    basis, size, _ = np.linalg.svd(np.linalg.solve(np.linalg.cholesky(inner), sketch.T).T, full_matrices=False)
    basis, size = np.pad(basis, ((0, 1), (0, RANK - basis.shape[1]))), np.pad(size, (0, RANK - len(size)))
    return Space(place, (basis / np.maximum(size, 0.05 * size[0]) * np.append(weight, 0)[:, None]).astype(np.float32))


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray
    answer: np.ndarray
    masks: dict[int, int] = field(default_factory=dict)
    answer_masks: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        for words, masks in ((self.words, self.masks), (self.answer, self.answer_masks)):
            for k, word in enumerate(words.tolist()):
                masks[word] = masks.get(word, 0) | 1 << k

    @property
    def needed(self) -> float:
        """Words of the item that a window must have before its order is looked at."""
        return len(self.words) if len(self.words) < SHORT else PARAPHRASE * len(self.words)


def item_of(item_id: int | None, text: str | None) -> Item:
    words, *sentences = hashed([text, *_SENTENCE.split(text or "")])
    sentences = [w for w in sentences if len(w)]
    return Item(item_id, words, sentences[-1] if sentences else np.zeros(0, np.uint32))


def common(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence of a list of ``size`` words, given by its masks, and ``words``."""
    rows = full = (1 << size) - 1
    for word in words:
        if mask := masks.get(word):
            both = rows & mask
            rows = (rows + both | rows - both) & full
    return size - rows.bit_count()


def leaked(item: Item, words: list[int]) -> int:
    """Common words of an item and a window if they make a leak, else 0."""
    n = len(item.words)
    found = common(item.masks, n, words)
    if found < item.needed:
        return 0
    if n < SHORT or found >= VERBATIM * n:
        return found
    return found if common(item.answer_masks, len(item.answer), words) == len(item.answer) else 0


def steps_for(words: int) -> int:
    """Steps of the window for an item: the first of 2, 3, 4, 6, 9, 13 ... that always holds it whole."""
    wide = 2
    while wide * STEP < words + STEP - 1:
        wide += max(1, wide // 2)
    return wide


class Class:
    """Items that share the width of their windows."""

    def __init__(self, wide: int, items: list[Item], space: Space):
        self.wide, self.items = wide, items
        vectors = np.array([space.rows[space.of(x.words)].sum(axis=0) for x in items])
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        self.vectors = np.ascontiguousarray(vectors / np.maximum(size, 1e-12), np.float32)
        # an item whose words all weigh nothing has no direction, so each of its windows is a candidate
        self.blind = size[:, 0] == 0
        self.needed = np.array([x.needed for x in items])
        self.masks = np.array([np.bitwise_or.reduce(space.bits[space.of(x.words)], axis=0) for x in items])
        # counts of at most 255 bits fit into bytes; an item that needs no common bit is met by all windows
        met = self.needed - [len(x.words) for x in items] + np.bitwise_count(self.masks).sum(axis=1, dtype=int)
        self.met = np.ceil(np.maximum(met, 0)).astype(np.uint8)
        self.times = np.zeros((len(items), len(space.rows)), np.uint16)  # the last place stands for no word
        for k, x in enumerate(items):
            np.add.at(self.times[k], space.of(x.words), 1)

    def near(self, windows: np.ndarray, masks: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items that may leak: enough of their bits meet, and their cosine is at least ``near``.

        Words in common are no more than common bits and what of the item's words share a bit, so the first
        condition loses nothing. ``windows`` and ``masks`` have a row of coordinates and of bits for each window.
        """
        common = np.bitwise_count(masks[:, 0, None] & self.masks[:, 0])
        for k in range(1, masks.shape[1]):
            common += np.bitwise_count(masks[:, k, None] & self.masks[:, k])
        rows, items = np.divmod(np.flatnonzero(common >= self.met), len(self.items))
        found = windows[rows].astype(np.float32)
        size = np.sqrt(np.einsum("ij,ij->i", found, found))
        cosine = np.einsum("ij,ij->i", found, self.vectors[items]) / np.maximum(size, 1e-12)
        close = (cosine >= near) & ((size > 0) | (near <= 0)) | self.blind[items]
        return rows[close], items[close]

    def enough(self, place: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which windows, a row of places each, have enough words in common with their item, counting repeats of both."""
        out = np.flatnonzero((self.times[item[:, None], place] > 0).sum(axis=1) >= self.needed[item])
        place, item = np.sort(place[out], axis=1), item[out]
        at = np.arange(place.shape[1])
        begins = np.zeros(place.shape, np.int64)
        begins[:, 1:] = np.where(place[:, 1:] != place[:, :-1], at[1:], 0)
        repeat = at - np.maximum.accumulate(begins, axis=1)
        return out[(self.times[item[:, None], place] > repeat).sum(axis=1) >= self.needed[item]]


@dataclass
class Search:
    """A block of benchmark items."""

    space: Space
    classes: list[Class]
    near: float = NEAR

    def find(self, texts: list[np.ndarray]) -> list[list[tuple]]:
        """For each text: (item_id, words, common, cosine, place) of the best window of each item that leaks."""
        out: list[list[tuple]] = [[] for _ in texts]
        group: list[int] = []
        size = 0
        for k, words in enumerate(texts):
            if len(words) and self.classes:
                group.append(k)
                size += len(words)
            if group and (size >= AT_ONCE or k == len(texts) - 1):
                self._search(group, [texts[g] for g in group], out)
                group, size = [], 0
        return out

    def _search(self, group: list[int], texts: list[np.ndarray], out: list[list[tuple]]) -> None:
        words = np.concatenate(texts)
        place = np.append(self.space.of(words), np.int32(len(self.space.rows) - 1))
        size = np.array([len(w) for w in texts])
        steps = -(-size // STEP)
        text = np.repeat(np.arange(len(texts)), steps)  # of each step, like the next three
        last = np.repeat(np.cumsum(steps), steps)
        start = (np.arange(len(text)) - (last - np.repeat(steps, steps))) * STEP + np.repeat(np.cumsum(size) - size, steps)
        end = np.repeat(np.cumsum(size), steps)
        best: dict[tuple[int, int], tuple] = {}
        widest = max(kind.wide for kind in self.classes)
        for at in range(0, len(text), WINDOWS):
            here = np.arange(at, min(at + WINDOWS, len(text)))
            stop = min(at + len(here) + widest, len(text))
            step = start[at:stop, None] + np.arange(STEP)  # the words of each step, and of each window the sums and bits of its steps
            step = place[np.where(step < end[at:stop, None], step, len(words))]
            total = np.zeros((len(step) + 1, RANK))
            np.cumsum(np.take(self.space.rows, step, axis=0).sum(axis=1), axis=0, out=total[1:])
            bits = np.bitwise_or.reduce(np.take(self.space.bits, step, axis=0), axis=1)
            masks, done = bits[:len(here)].copy(), 1
            for kind in self.classes:
                reach = np.arange(kind.wide * STEP)
                for done in range(done, kind.wide):  # classes are in the order of their widths
                    inside = np.flatnonzero(here + done < last[here])
                    masks[inside] |= bits[inside + done]
                done = kind.wide
                windows = np.take(total, np.minimum(here + kind.wide, last[here]) - at, axis=0) - total[:len(here)]
                rows, items = kind.near(windows, masks, self.near)
                many = max(1, PAIRS // len(reach))
                for k in range(0, len(rows), many):
                    i, j = rows[k:k + many], items[k:k + many]
                    word = start[at + i][:, None] + reach
                    word = np.where(word < end[at + i][:, None], word, len(words))
                    enough = kind.enough(place[word], j)
                    for a, b in zip(i[enough].tolist(), j[enough].tolist(), strict=True):
                        low = start[at + a]
                        high = min(low + len(reach), end[at + a])
                        if found := leaked(kind.items[b], words[low:high].tolist()):
                            cosine = float(windows[a] @ kind.vectors[b]) / max(float(np.linalg.norm(windows[a])), 1e-9)
                            owned = int(text[at + a])
                            key = (owned, id(kind.items[b]))
                            row = (found, round(cosine, 6), -int(low - (end[at + a] - size[owned])), kind.items[b])
                            if key not in best or row[:3] > best[key][:3]:
                                best[key] = row
        for (owned, _), (found, cosine, first, item) in best.items():
            out[group[owned]].append((item.item_id, len(item.words), found, cosine, -first))


def items_in_blocks(benchmark: DataFrame) -> Iterator[list[Item]]:
    """The items of ``benchmark`` (item_id, text) that have words, ``ITEMS`` or so at a time."""
    rows = benchmark.where("text is not null").select("item_id", "text")
    blocks = -(-rows.count() // ITEMS)
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield [x for x in (item_of(r["item_id"], r["text"]) for r in own) if len(x.words)]


def search_for(items: list[Item], space: Space, near: float = NEAR) -> Search:
    classes: dict[int, list[Item]] = {}
    for item in items:
        classes.setdefault(steps_for(len(item.words)), []).append(item)
    return Search(space, [Class(wide, own, space) for wide, own in sorted(classes.items())], near)


LEAKS = "array<struct<item_id:long,item_words:int,common_words:int,cosine:double,place:int>>"


def leaks_of(words: Column, search: Search) -> Column:
    """The leaks of a text, given by the hashes of its words; one for each item."""
    shared = SparkSession.active().sparkContext.broadcast(search)  # ITEMS items and the space: bounded

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("item_words", pa.int32()), ("common_words", pa.int32()),
                                   ("cosine", pa.float64()), ("place", pa.int32())]))
        names = [kind.value_type.field(i).name for i in range(5)]
        for batch in batches:
            rows = shared.value.find([np.frombuffer(x.as_buffer(), "<u4") for x in batch])
            yield pa.array([[dict(zip(names, x, strict=True)) for x in r] for r in rows], kind)

    return F.arrow_udf(found, LEAKS)(words)


def marked(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None,
           near: float = NEAR) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` and ``__leaks``: the benchmark items that each text contains.

    The latent space is fitted once, on all texts of ``docs`` and the words of all items; ``benchmark``
    has ``item_id`` and ``text``. Words are hashed once and written to the shared folder with the
    kept columns. Null and empty texts have no leaks and items without words are in no text. Rows
    are judged one by one, so null and repeated ids stay as they are; without documents or items
    there are no leaks. Of windows that tie the one with the larger cosine and then the first is reported.
    """
    keep = docs.columns if keep is None else keep
    words = settle(docs.select(*keep, word_hashes(F.col(text_col)).alias("__words")), "words")
    known = np.zeros(FEATURES, bool)
    for items in items_in_blocks(benchmark):
        for item in items:
            known[item.words & FEATURES - 1] = True
    space = latent_space(words.select(F.col("__words").alias("words")), known)
    found = [leaks_of(F.col("__words"), search_for(items, space, near)) for items in items_in_blocks(benchmark)]
    leaks = F.concat(*found) if found else F.array().cast(LEAKS)
    return words.select(*keep, leaks.alias("__leaks"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: float = NEAR) -> DataFrame:
    """A row for each contaminated document and item it contains.

    Columns: the id, ``item_id``, ``item_words``, ``common_words`` (of the longest common subsequence
    with the best window), ``cosine`` (of that window), ``place`` (its first word in the text, from 0).
    Clean documents have no row. See ``marked`` for nulls; other columns are not read.
    """
    rows = marked(docs.select(F.col(id_col), F.col(text_col)), benchmark, text_col, [id_col], near)
    return rows.select(id_col, F.explode("__leaks").alias("leak")).select(id_col, "leak.*")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", near: float = NEAR) -> DataFrame:
    """The rows of ``docs``, with all columns, that contain no benchmark item."""
    return marked(docs, benchmark, text_col, near=near).where(F.size("__leaks") == 0).drop("__leaks")
