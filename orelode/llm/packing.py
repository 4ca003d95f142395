"""Packing by powers of two: each document is cut into pieces of binary lengths.

A document of n tokens becomes whole sequences of the largest size and one piece
for each binary digit of the rest. Every sequence is one piece, its length is a
power of two, and sequences of equal length form a bucket. So no sequence crosses
documents, nothing is padded, and cutting needs no other row: there is no shuffle.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

END = 1
LARGEST = 2048

#: Words whose ids a worker remembers before it starts afresh; only time depends on it.
REMEMBERED = 150_000

# The pattern that splits text before the merges, and the characters it counts as space.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"

_STARTS = re.compile(f"(?= [^{SPACES}])")


def _bytes_of_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable bytes stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ids:
    """Token ids of texts under a byte-level vocabulary file, equal to those of its tokenizer.

    A space before a visible character always begins a token, so a text is cut there and
    the ids of each word are looked up. Words not yet seen are merged together with the
    ranks of the same file and told apart by the tokens that begin with a space. Texts that
    hold a special token go through the tokenizer itself.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        self.special = [x["content"] for x in vocabulary["added_tokens"]]
        letters = _bytes_of_letters()
        ranks = {bytes(letters[c] for c in k): v for k, v in vocabulary["model"]["vocab"].items()
                 if k not in self.special}
        self.merge = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.begins = np.zeros(max(ranks.values()) + 1, bool)
        self.begins[[v for k, v in ranks.items() if k[:1] == b" "]] = True
        self.words: dict[str, bytes] = {}

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """Loaded where it is first needed, as few workers meet a special token."""
        return Tokenizer.from_file(self.path)

    def merged(self, text: str) -> bytes:
        return self.merge.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Remembers the ids of all words that a space can stand before."""
        fresh = [w for w in words.difference(self.words) if w and w[0] not in SPACES]
        if not fresh:
            return
        if len(self.words) > REMEMBERED:
            self.words.clear()
            fresh = [w for w in words if w and w[0] not in SPACES]
        ids = self.merge.encode_to_numpy(" " + " ".join(fresh), disallowed_special=()).astype("<u4")
        at = (4 * np.append(np.flatnonzero(self.begins[ids]), len(ids))).tolist()
        data = ids.tobytes()
        self.words.update(zip(fresh, map(data.__getitem__, map(slice, at, at[1:])), strict=True))

    def of(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        cuts = [text.split(" ") for text in texts]
        self.learn(set(chain.from_iterable(cuts)))
        for text, words in zip(texts, cuts, strict=True):
            if any(x in text for x in self.special):
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            try:
                yield self.merged(words[0]) + b"".join(map(self.words.__getitem__, words[1:]))
            except KeyError:  # a space stands before white space or the end
                yield b"".join(map(self.merged, _STARTS.split(text)))


@cache
def ids_of(path: str) -> Ids:
    return Ids(path)


def cut(n: int, largest: int = LARGEST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: powers of two, longest first, without a gap."""
    starts = [(i * largest, largest) for i in range(n // largest)]
    at, rest = n - n % largest, n % largest
    while rest:
        length = 1 << (rest.bit_length() - 1)
        starts.append((at, length))
        at, rest = at + length, rest - length
    return starts


PIECES = "array<struct<start:long,length:long,ids_crc32:long,doc_tokens:long,ids:binary>>"


def _pieces(path: str, largest: int, with_ids: bool):
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                      ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids = ids_of(path)
        for batch in batches:
            offsets, starts, lengths, sums, totals, datas = [0], [], [], [], [], []
            for own in ids.of([x or "" for x in batch.to_pylist()]):
                own += END.to_bytes(4, "little")
                for start, length in cut(len(own) // 4, largest):
                    data = own[4 * start:4 * (start + length)]
                    starts.append(start)
                    lengths.append(length)
                    sums.append(zlib.crc32(data))
                    totals.append(len(own) // 4)
                    datas.append(data if with_ids else None)
                offsets.append(len(starts))
            rows = pa.StructArray.from_arrays(
                [pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
                 pa.array(totals, pa.int64()), pa.array(datas, pa.binary())], fields=list(kind))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return F.arrow_udf(pieces, PIECES)


def pack(docs: DataFrame, vocabulary: str, largest: int = LARGEST, with_ids: bool = True,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed pieces of all texts; ``vocabulary`` is the path of a tokenizer file on every executor.

    Columns: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``,
    ``offset`` (always 0: a sequence is one piece), ``bucket`` (binary logarithm of the
    length) and, with ``with_ids``, ``ids`` (little-endian unsigned 32-bit). Sequences are
    numbered by input split and place in it, so a task that runs again gives the same numbers
    as long as ``docs`` is a table that is read.

    A null or empty text is one piece, the end id. Repeated rows and null ids are packed
    like others, each into sequences of its own. Other columns are not read.
    """
    if largest < 1 or largest & (largest - 1):
        raise ValueError("the largest length must be a power of two")
    pieces = _pieces(vocabulary, largest, with_ids)(F.col(text_col))
    rows = docs.select(F.col(id_col), F.explode(pieces).alias("piece"))
    keep = ["piece.start", "piece.length", "piece.ids_crc32"] + (["piece.ids"] if with_ids else [])
    return rows.select(
        id_col, *keep, "piece.doc_tokens", F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), F.log2("piece.length").cast("int").alias("bucket"))


def write_buckets(packed: DataFrame, folder: str) -> None:
    """The sequences as Parquet, one folder for each length, so that a reader gets full matrices of one shape.

    With every row go the cumulative segment lengths, 0 and the length, and the position
    reset, 0: a sequence holds one segment. The write needs no shuffle.
    """
    packed.select(
        "sequence_id", "ids", F.array(F.lit(0).cast("long"), F.col("length")).alias("cu_seqlens"),
        F.array("offset").alias("position_resets"), "bucket").write.partitionBy("bucket").parquet(folder)
