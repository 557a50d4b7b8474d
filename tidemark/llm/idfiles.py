"""Token-id files: one concatenated id array per segment with Elias-Fano coded document borders."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.tokens import encoder, text_groups

#: Ids after which a segment is closed.
SEGMENT_IDS = 1 << 20
#: Every so many ones of the high part, the place of one is noted for select.
HINT = 64
SEGMENT = "part int, segment int, n_docs long, n_ids long, width int, doc_ids array<long>, ids binary, low_bits int, low binary, high binary, hints binary"


@dataclass
class EliasFano:
    """A non-decreasing sequence in about 2 + log2(largest / n) bits a value.

    The lowest bits of each value stand packed in `low`; value i sets bit (value >> low_bits) + i of `high`. `hints` has the place of every 64th one.
    """

    n: int
    low_bits: int
    low: bytes
    high: bytes
    hints: bytes

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if n == 0:
            return cls(0, 0, b"", b"", b"")
        low_bits = max(0, int(values[-1] // n).bit_length() - 1)
        low = (values[:, None] >> np.arange(low_bits)) & 1
        ones = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::HINT].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        out = 0
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            out |= (self.low[at >> 3] >> (at & 7) & 1) << b
        return out

    def select(self, i: int) -> int:
        """Value i: from the nearest hint the ones are counted byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int.from_bytes(self.hints[i // HINT * 4 : i // HINT * 4 + 4], "little")
        left = i % HINT
        byte = self.high[at >> 3] >> (at & 7) << (at & 7)
        where = at >> 3
        while (ones := byte.bit_count()) <= left:
            left -= ones
            where += 1
            byte = self.high[where]
        for _ in range(left):
            byte &= byte - 1
        place = where * 8 + (byte & -byte).bit_length() - 1
        return ((place - i) << self.low_bits) | self._low(i)

    def values(self) -> np.ndarray:
        """All values at once."""
        if self.n == 0:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            out |= bits.astype(np.int64) @ (1 << np.arange(self.low_bits))
        return out


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every text, append `end_id`, and write segments of whole documents in ascending id order (nulls first; equal ids by a hash of the text).

    A range shuffle brings the texts into order; each task streams its range and holds one open segment. Ids take two bytes each where the vocabulary
    allows it. Segments are rows of Parquet, so that they live wherever Spark can write and a lost executor's half-written file never counts.
    Null text: empty. Other columns are not read.
    """

    def segments(batches):
        part, number = TaskContext.get().partitionId(), 0
        names, ids, size = [], [], 0
        tool = encoder(vocabulary, False)
        width = 2 if max(tool.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()

        def closed():
            ends = np.cumsum([len(x) // 4 for x in ids])
            ef = EliasFano.encode(ends)
            raw = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}").tobytes()
            row = [part, number, len(ids), size, width, names, raw, ef.low_bits, ef.low, ef.high, ef.hints]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, ARROW)], names=SEGMENT_NAMES)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, group in text_groups(batch.column(1).to_pylist()):
                for i, b in enumerate(tool.encode(group)):
                    names.append(keys[at + i])
                    ids.append(b + end)
                    size += len(b) // 4 + 1
                    if size >= segment_ids:
                        yield closed()
                        names, ids, size, number = [], [], 0, number + 1
        if ids:
            yield closed()

    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(segments, SEGMENT).write.mode("overwrite").parquet(path)


SEGMENT_NAMES = [c.split()[0] for c in SEGMENT.split(", ")]
ARROW = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def read_ids(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, on request, its ids.

    The start of a segment is a running sum in two steps: over the parts (one row per written file) and over the segments of a part.
    """
    stored = spark.read.parquet(path)
    sizes = stored.select("part", "segment", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("total"))
    parts = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before_part"))
    inside = Window.partitionBy("part").orderBy("segment")
    bases = sizes.withColumn("before", F.sum("n_ids").over(inside) - F.col("n_ids")).join(parts, "part")
    bases = bases.select("part", "segment", (F.col("before") + F.col("before_part")).alias("base"))

    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ends = EliasFano(row["n_docs"], row["low_bits"], row["low"], row["high"], row["hints"]).values()
                raw = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4").tobytes()
                starts = np.append(0, ends[:-1])
                ids = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(ids)
                columns = [
                    pa.array([row["part"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()),
                    pa.array(ends - starts, pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                ]
                names = ["part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "part int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    rows = stored.select("part", "segment", "n_docs", "width", "doc_ids", "ids", "low_bits", "low", "high", "hints").mapInArrow(documents, schema)
    return rows.join(bases, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)
