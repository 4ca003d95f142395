"""Token matrices: documents packed into rows of one length by best-fit decreasing.

A document longer than a row fills whole rows first; what is left of each is a piece. A
task packs its pieces in groups of a bounded number, longest first, each into the open
row with the least room that still holds it; a segment tree over the room of open rows
finds that row. Rows that stay too empty are opened again with the next group. Packing
needs no other task: there is no shuffle, and no task holds more than a group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.packing import END, ids_of

LENGTH = 2048
#: Pieces packed at once, how full a row must be to stay closed, and the share of a group that may wait for the next.
GROUP = 4096
FULL = 0.98
WAITING = 0.25
#: Rows handed on at once.
ROWS = 256

MATRIX = ("sequence_id long, ids binary, cu_seqlens array<int>, position_resets array<int>, "
          "segments array<struct<doc_id:long,start:long,length:long,ids_crc32:long,doc_tokens:long>>")
_SEGMENT = pa.struct([(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])


class Room:
    """Open rows by the room they have left: a segment tree that counts them for every range of room."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, n: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += n
            at >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``need``, and that room; None if there is none."""
        at = self.leaves + need
        while not self.count[at]:
            while at & 1:  # a right child: nothing of its parent lies further right
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Rows of piece numbers: longest first, each piece where the least room remains; ties keep their order."""
    room = Room(most)
    rows: list[list[int]] = []
    for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if (found := room.take(lengths[k])) is None:
            found = len(rows), most
            rows.append([])
        row, left = found
        rows[row].append(k)
        room.put(row, left - lengths[k])
    return rows


class _Packer:
    """Rows of one task. A piece is (doc_id, start, data, doc_tokens), its data 32-bit ids."""

    def __init__(self, length: int, kind: str, pad: int):
        self.length, self.kind, self.pad = length, kind, pad
        self.held: list[tuple] = []
        self.done: list[tuple] = []
        self.next = TaskContext.get().partitionId() << 33

    def add(self, doc_id: int | None, data: bytes) -> None:
        n = len(data) // 4
        for start in range(0, n - self.length + 1, self.length):
            self.close([(doc_id, start, data[4 * start:4 * (start + self.length)], n)])
        if start := n % self.length:
            self.held.append((doc_id, n - start, data[4 * (n - start):], n))

    def pack(self, last: bool) -> None:
        rows = best_fit([len(p[2]) // 4 for p in self.held], self.length)
        held, self.held = self.held, []
        waiting = 0
        for row in reversed(rows):  # the emptiest rows are among the last opened
            pieces = [held[k] for k in row]
            if not last and sum(len(p[2]) for p in pieces) < 4 * FULL * self.length \
                    and waiting + len(pieces) <= WAITING * GROUP:
                waiting += len(pieces)
                self.held += pieces
            else:
                self.close(pieces)

    def close(self, pieces: list[tuple]) -> None:
        data = b"".join(p[2] for p in pieces)
        ids = np.full(self.length, self.pad, self.kind)
        ids[:len(data) // 4] = np.frombuffer(data, "<u4")
        edges = np.cumsum([0] + [len(p[2]) // 4 for p in pieces]).tolist()
        segments = [{"doc_id": d, "start": s, "length": len(x) // 4, "ids_crc32": zlib.crc32(x), "doc_tokens": n}
                    for d, s, x, n in pieces]
        self.done.append((self.next, ids.tobytes(), edges, edges[:-1], segments))
        self.next += 1

    def taken(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.done) >= least:
            columns = list(zip(*self.done, strict=True))
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(_SEGMENT)]
            names = ["sequence_id", "ids", "cu_seqlens", "position_resets", "segments"]
            self.done = []
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def matrices(docs: DataFrame, vocabulary: str, length: int = LENGTH, kind: str = "<u2", pad: int = 0,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of a token matrix; ``vocabulary`` is the path of a tokenizer file on every executor.

    Columns: ``sequence_id``; ``ids``, ``length`` numbers of the NumPy type ``kind``, padded at the end;
    ``cu_seqlens``, the running total of segment lengths from 0; ``position_resets``, where each
    segment begins; ``segments`` (doc_id, start in the document, length, crc32 of its ids as
    little-endian unsigned 32-bit, tokens of the document). Every id of every document and its
    end id lie in exactly one segment. Rows are numbered by input split, so a task that runs
    again gives the same numbers as long as ``docs`` is a table that is read.

    A null or empty text is the end id alone. Repeated rows and null ids are packed like
    others. Other columns are not read.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(vocabulary)
        if len(ids.begins) - 1 > np.iinfo(kind).max:
            raise ValueError("the type is too small for the vocabulary")
        packer = _Packer(length, kind, pad)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), ids.of(texts), strict=True):
                packer.add(doc_id, data + END.to_bytes(4, "little"))
                if len(packer.held) >= GROUP:
                    packer.pack(last=False)
                yield from packer.taken(ROWS)
        packer.pack(last=True)
        yield from packer.taken(1)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        packed, MATRIX)


def segments(rows: DataFrame) -> DataFrame:
    """A row for each segment of a token matrix: where its ids are in their document and in the matrix."""
    split = rows.select("sequence_id", F.posexplode("segments").alias("place", "segment"), "cu_seqlens")
    return split.select("segment.*", "sequence_id", F.element_at("cu_seqlens", F.col("place") + 1).cast("long").alias("offset"))
