"""URL rules by Bloom filter cascades: exact membership in rule lists without a join with them.

The keys that can be asked are known: every host suffix and path beginning that some URL of the corpus
has and that is as long as one of a rule. The first filter of a cascade encodes the listed keys; the second
encodes the other keys of this universe that the first one takes for listed; the third encodes the
listed keys that the second one takes for others; and so on until no key is mistaken. The first
level that does not have a key tells its list, so the answer is exact for every key of the universe.

There is a cascade for the rules that block and one for those that allow. The longest rule of a URL is the
longest of its keys that either has. All filters together take some bits for each listed key, however
large the corpus; lists beyond ``BROADCAST`` bytes of filters are asked in several passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.llm.shared import settle

#: Listed keys of a part of a list, and bytes of the filters that are sent to all executors at once.
PART_KEYS = 1 << 20
BROADCAST = 1 << 26
#: Levels beyond which two keys must have the same 128 bits of hash.
DEEPEST = 64

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass
class Level:
    """A Bloom filter in ``parts`` equal parts of ``bits`` bits, in 64-bit words of the table ``words`` (word, data)."""

    number: int
    hashes: int
    bits: int
    parts: int
    words: DataFrame

    def places(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The bits of each key, given by two hashes: a row of places in the whole filter."""
        step = np.arange(self.hashes, dtype=np.uint64) + np.uint64(64 * self.number)
        x = h[:, None] + (g[:, None] | np.uint64(1)) * (step + np.uint64(1))
        x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        return (h % np.uint64(self.parts))[:, None] * np.uint64(self.bits) + x % np.uint64(self.bits)

    def loaded(self, first: int, last: int) -> np.ndarray:
        """The words of the parts from ``first`` to before ``last``: at most ``BROADCAST`` bytes over all levels."""
        wide = self.bits // 64
        out = np.zeros((last - first) * wide, np.uint64)
        for r in self.words.where(f"word >= {first * wide} and word < {last * wide}").toLocalIterator():
            out[r["word"] - first * wide] = np.uint64(r["data"] & 0xFFFFFFFFFFFFFFFF)
        return out


class Loaded:
    """A pass: the parts of all levels of a cascade that are asked at once."""

    def __init__(self, levels: list[Level], first: int, last: int):
        self.first, self.last = first, last
        self.levels = [Level(x.number, x.hashes, x.bits, x.parts, None) for x in levels]
        self.data = [x.loaded(first, last) for x in levels]

    def own(self, h: np.ndarray) -> np.ndarray:
        part = h % np.uint64(self.levels[0].parts)
        return (part >= self.first) & (part < self.last)

    def has(self, k: int, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Which keys of this pass the filter of level ``k`` has."""
        place = self.levels[k].places(h, g) - np.uint64(self.first * self.levels[k].bits)
        return (self.data[k][place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).all(axis=1)

    def listed(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Which keys are listed; keys of other passes are not."""
        out = np.zeros(len(h), bool)
        open_ = np.flatnonzero(self.own(h))
        for k in range(len(self.levels)):
            out[open_] = k % 2 == 1  # what ends here, unless this filter has it
            open_ = open_[self.has(k, h[open_], g[open_])]
        out[open_] = len(self.levels) % 2 == 1
        return out


def _longs(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _encoded(keys: DataFrame, level: Level) -> DataFrame:
    """(word, data): the filter with all ``keys`` (h, g). Bits meet in the map tasks before the shuffle."""

    def places(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for h, g in batches:
            place = level.places(_longs(h), _longs(g)).astype(np.int64)
            yield pa.ListArray.from_arrays(
                pa.array(np.arange(len(place) + 1, dtype=np.int32) * level.hashes), pa.array(place.ravel()))

    place = keys.select(F.explode(F.arrow_udf(places, "array<long>")("h", "g")).alias("place"))
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    return place.groupBy(F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(bit).alias("data"))


class Cascade:
    """Exact membership of the keys of a universe in a list."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def passes(self) -> list[tuple[int, int]]:
        """The parts of each pass."""
        parts = self.levels[0].parts
        step = max(1, BROADCAST // (sum(x.bits for x in self.levels) // 8))
        return [(k, min(k + step, parts)) for k in range(0, parts, step)]

    @classmethod
    def build(cls, keys: DataFrame) -> Cascade:
        """The cascade of ``keys`` (h, g, listed): distinct keys by two hashes, the listed ones and all others that can be asked."""
        this = cls([])
        sides = [keys.where("listed").select("h", "g"), keys.where("not listed").select("h", "g")]
        sizes = [x.count() for x in sides]
        parts = -(-sizes[0] // PART_KEYS)
        while sizes[0]:
            number = len(this.levels)
            # the first level lets about as many others through as there are listed keys, each further one half
            hashes = min(30, max(1, round(math.log2(max(2, sizes[1] / sizes[0]))))) if number == 0 else 1
            bits = 64 * math.ceil(sizes[0] * hashes / math.log(2) / parts / 64)
            level = Level(number, hashes, bits, parts, None)
            level.words = settle(_encoded(sides[0], level), "filter")
            this.levels.append(level)
            if number == DEEPEST:
                raise ValueError("two keys have the same hashes")
            # what is mistaken for the keys just encoded is encoded next
            mistaken = settle(this._taken(sides[1], number), "mistaken")
            sides = [mistaken, sides[0]]
            sizes = [mistaken.count(), sizes[0]]
        return this

    def _taken(self, keys: DataFrame, number: int) -> DataFrame:
        """The ``keys`` (h, g) that the filter of a level has."""
        out = keys.limit(0)
        for first, last in self.passes():
            has = _has(keys.sparkSession.sparkContext.broadcast(Loaded(self.levels[number:number + 1], first, last)))
            out = out.union(keys.where(has("h", "g")))
        return out

    def mark(self, rows: DataFrame, h: str, g: str, out: str) -> DataFrame:
        """``rows`` with the column ``out``: for arrays ``h`` and ``g`` of hashes, which of the keys are listed.

        Filters beyond ``BROADCAST`` bytes are asked in several passes over the rows, each of a bounded size.
        """
        rows = rows.withColumn(out, F.transform(h, lambda x: F.lit(False)))
        for k, (first, last) in enumerate(self.passes() if self.levels else []):
            listed = _listed(rows.sparkSession.sparkContext.broadcast(Loaded(self.levels, first, last)))
            rows = settle(rows, "pass") if k else rows
            rows = rows.withColumn(out, F.zip_with(out, listed(h, g), lambda a, b: a | b))
        return rows


def _has(loaded: Broadcast):
    """Which keys the one level of ``loaded`` has."""

    def has(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for h, g in batches:
            h, g = _longs(h), _longs(g)
            own = np.flatnonzero(loaded.value.own(h))
            yes = np.zeros(len(h), bool)
            yes[own] = loaded.value.has(0, h[own], g[own])
            yield pa.array(yes)

    return F.arrow_udf(has, "boolean")


def _listed(loaded: Broadcast):
    """Which keys of arrays of keys are listed."""

    def listed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hs, gs in batches:
            flat = loaded.value.listed(_longs(hs.flatten()), _longs(gs.flatten()))
            size = hs.value_lengths().to_numpy(zero_copy_only=False)
            yield pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(flat))

    return F.arrow_udf(listed, "array<boolean>")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g")]


def _keys(host: Column, path: Column, labels: Column, lengths: Column) -> Column:
    """The keys of a URL: suffixes of its host with numbers of ``labels`` and beginnings of its path with ``lengths``.

    Longest first, and of equal length those with the longer host.
    """
    parts = F.split(host, r"\.")
    hosts = F.transform(F.filter(labels, lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    paths = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    keys = F.flatten(F.transform(hosts, lambda x: F.transform(paths, lambda y: F.struct(
        (-F.length(x) - F.length(y)).alias("size"), (-F.length(x)).alias("wide"), F.concat(x, F.lit("\n"), y).alias("key")))))
    return F.transform(F.array_sort(keys), lambda k: k["key"])


def judged(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (which replace columns of these names).

    ``rules`` (host, path, block): a rule fits its host and all subdomains if the path begins with the rule's. The
    longest rule, host and path together, decides; of equally long ones that with the longer host, and a rule
    that is listed both ways blocks. ``rule`` is null and the URL allowed where no rule fits. Rules with a null
    are left out, hosts are taken in lower case (A-Z). URLs that are null or have no ``://`` have an empty host and path.
    Rows are judged one by one, so null and repeated ids and repeated rows stay; other columns are kept.

    What a rule is asked for takes the numbers of labels and the lengths of paths that rules have; these
    go through the driver, as many as the longest rule has characters at most.
    """
    given = rules.where("host is not null and path is not null and block is not null").select(
        F.translate("host", _UPPER, _UPPER.lower()).alias("host"), "path", "block").distinct()
    given = settle(given, "rules")
    sizes = given.select(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"),
                         F.collect_set(F.length("path")).alias("lengths")).first()
    labels, lengths = (F.array(*(F.lit(x) for x in sorted(s))).cast("array<int>") for s in sizes)
    parts = pages.select("*", host_of(F.col(url_col)).alias("__host"), path_of(F.col(url_col)).alias("__path"))
    rows = parts.withColumn("__keys", _keys(F.col("__host"), F.col("__path"), labels, lengths))
    asked = rows.select(F.explode("__keys").alias("key")).distinct()
    listed = given.select(F.concat("host", F.lit("\n"), "path").alias("key"), "block")
    # a key for each row, with the lists it is in, as an aggregate and not a join
    every = asked.select("key", F.lit(False).alias("block"), F.lit(False).alias("allow")).union(
        listed.select("key", "block", (~F.col("block")).alias("allow"))).groupBy("key").agg(
        F.max("block").alias("block"), F.max("allow").alias("allow"))
    universe = settle(every.select(*_hashes(F.col("key")), "block", "allow"), "universe")
    rows = rows.withColumns({
        "__h": F.transform("__keys", lambda k: _hashes(k)[0]), "__g": F.transform("__keys", lambda k: _hashes(k)[1])})
    for side in ("block", "allow"):
        cascade = Cascade.build(universe.select("h", "g", F.col(side).alias("listed")))
        rows = cascade.mark(rows, "__h", "__g", f"__{side}")
    # keys are in order, so the first that is listed decides
    first = F.array_position(F.zip_with("__block", "__allow", lambda a, b: a | b), True).cast("int")
    rows = rows.withColumn("__first", first)
    blocked = F.get("__block", F.col("__first") - 1)
    rule = F.when(F.col("__first") > 0, F.translate(F.get("__keys", F.col("__first") - 1), "\n", ""))
    return rows.select(
        *(c for c in pages.columns if c not in ("host", "path", "rule", "verdict")),
        F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"),
        F.when(F.coalesce(blocked, F.lit(False)), "block").otherwise("allow").alias("verdict"))
