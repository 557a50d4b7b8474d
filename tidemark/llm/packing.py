"""Bounded-space online packing of tokenized texts into fixed windows."""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import encoder, text_groups

PIECE = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, target long"
NAMES = [c.split()[0] for c in PIECE.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
#: Sequence ids of the merging step stand above all of the first one.
MERGED = 1 << 62


@dataclass
class OpenWindows:
    """At most `most` windows are open. A piece goes where the least room is left; if it fits nowhere, the fullest window is emitted. Where more than
    `gap` ids would stay empty there, the head of the piece fills them and the rest is placed again."""

    size: int
    most: int
    gap: int
    rooms: list[tuple[int, int]] = field(default_factory=list)  # (room, number), ascending
    inside: dict[int, list[tuple]] = field(default_factory=dict)
    number: int = 0

    def new(self) -> int:
        self.number += 1
        return self.number - 1

    def place(self, piece: tuple):
        """piece: (doc_id, start, ids as bytes, doc_tokens). Yields (number, pieces) of windows that close."""
        while True:
            doc, start, ids, total = piece
            n = len(ids) // 4
            if n >= self.size:
                yield self.new(), [(doc, start, ids[: self.size * 4], total)]
                if n == self.size:
                    return
                piece = (doc, start + self.size, ids[self.size * 4 :], total)
                continue
            at = bisect.bisect_left(self.rooms, (n, -1))
            if at < len(self.rooms):
                room, number = self.rooms.pop(at)
                self.inside[number].append(piece)
                if room == n:
                    yield number, self.inside.pop(number)
                else:
                    bisect.insort(self.rooms, (room - n, number))
                return
            if len(self.rooms) < self.most:
                number = self.new()
                self.inside[number] = [piece]
                bisect.insort(self.rooms, (self.size - n, number))
                return
            room, number = self.rooms.pop(0)
            pieces = self.inside.pop(number)
            if room > self.gap:
                pieces.append((doc, start, ids[: room * 4], total))
                piece = (doc, start + room, ids[room * 4 :], total)
            yield number, pieces

    def rest(self):
        """The windows that are still open, the fullest first."""
        for _, number in self.rooms:
            yield number, self.inside.pop(number)
        self.rooms = []


def _batches(rows, most: int = 8192, most_bytes: int = 8_000_000):
    """Rows of PIECE as Arrow batches."""
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += len(row[3] or b"")
        if len(kept) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), TYPES)], names=NAMES)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), TYPES)], names=NAMES)


def _rows(window: tuple[int, list[tuple]], base: int, still_open: bool, keep_ids: bool, target: int):
    number, pieces = window
    offset = 0
    for doc, start, ids, total in pieces:
        n = len(ids) // 4
        yield doc, start, n, ids if keep_ids or still_open else None, zlib.crc32(ids), total, base + number, offset, still_open, target
        offset += n


def pack(docs: DataFrame, vocabulary: str, end_id: int, size: int = 2048, windows: int = 32, gap: int = 16, keep_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token sequences of at most `size` ids, one row per piece: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    Every partition streams its documents through at most `windows` open windows (see OpenWindows). What is open at its end goes, with its ids, to the
    merging step: tasks that each take the leftovers of some partitions, pack them the same way, and at last lay the few open windows end to end. The
    only sequences with more than `gap` empty ids are thus one per merging task. Closed windows pass that shuffle as a few numbers a piece.
    Null text: empty, which leaves the end id alone. Rows with equal or null doc_id are packed as separate documents. Rows in the order of the
    input's partitions decide the packing: give a table or a written stage, whose order a repeated task finds again. Other columns are not read.
    """

    def first(batches):
        part = TaskContext.get().partitionId()
        tool, end = encoder(vocabulary, True), np.array([end_id], "<u4").tobytes()
        state = OpenWindows(size, windows, gap)

        def rows():
            for batch in batches:
                keys = batch.column(0).to_pylist()
                for at, group in text_groups(batch.column(1).to_pylist()):
                    for i, ids in enumerate(tool.encode(group)):
                        for window in state.place((keys[at + i], 0, ids + end, len(ids) // 4 + 1)):
                            yield from _rows(window, part << 32, False, keep_ids, (part << 32) + window[0])
            for window in state.rest():
                yield from _rows(window, part << 32, True, keep_ids, part)

        yield from _batches(rows())

    def merge(batches):
        part = TaskContext.get().partitionId()
        state = OpenWindows(size, windows, gap)

        def rows():
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if not row[8]:
                        yield row
                        continue
                    for window in state.place((row[0], row[1], row[3], row[5])):
                        yield from _rows(window, MERGED + (part << 32), False, keep_ids, 0)
            line, room = [], size
            for _, pieces in state.rest():
                for doc, start, ids, total in pieces:
                    while ids:
                        line.append((doc, start, ids[: room * 4], total))
                        taken = len(line[-1][2]) // 4
                        start, ids, room = start + taken, ids[taken * 4 :], room - taken
                        if room == 0:
                            yield from _rows((state.new(), line), MERGED + (part << 32), False, keep_ids, 0)
                            line, room = [], size
            if line:
                yield from _rows((state.new(), line), MERGED + (part << 32), False, keep_ids, 0)

        yield from _batches(rows())

    packed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(first, PIECE)
    packed = packed.repartition("target").sortWithinPartitions("open", "sequence_id", "offset").mapInArrow(merge, PIECE)
    return packed.select("doc_id", "start", "length", *["ids"] * keep_ids, "ids_crc32", "doc_tokens", "sequence_id", "offset")
