"""Hard negatives by exact inner products of integer vectors, scored with subset-sum tables (the method of Four Russians)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.graph import write_table
from tidemark.session import scratch_dir

#: Anchors whose tables one task holds (2 KB for each eight dimensions of an anchor), and rows that are streamed past them.
ANCHORS, ROWS = 1024, 1 << 20
#: Every block of anchors is met by so many tasks at least.
LEAST_SLICES = 8
#: Rows scored at once.
CHUNK, STEP = 4096, 256


def encode(vectors: pa.Array, scale: float) -> list[bytes | None]:
    """Per vector the bit planes of floor(scale * x): the number of planes, then for each plane one byte for every eight dimensions, lowest bit first.

    Two's complement with as many planes as the vector itself needs; None for null vectors and those with null or non-finite entries.
    """
    out: list[bytes | None] = [None] * len(vectors)
    offsets = np.asarray(vectors.offsets)
    flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    there = np.asarray(vectors.is_valid())
    sizes = np.where(there, np.diff(offsets), -1)
    for d in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        values = flat[offsets[rows][:, None] + np.arange(d)]
        fine = np.isfinite(values).all(axis=1)
        rows, scaled = rows[fine], np.floor(values[fine] * scale)
        if scaled.size and np.abs(scaled).max() >= 2.0**62:
            raise OverflowError("a scaled component does not fit a long")
        x = scaled.astype(np.int64)
        most = np.where(x < 0, ~x, x).max(axis=1, initial=0)
        planes = np.frexp(most.astype(np.float64))[1] + 1
        for p in np.unique(planes).tolist():
            of = np.flatnonzero(planes == p)
            bits = ((x[of][:, None, :] >> np.arange(p)[:, None]) & 1).astype(np.uint8)
            packed = np.packbits(bits, axis=2, bitorder="little").reshape(len(of), -1)
            for i, row in zip(rows[of].tolist(), packed):
                out[i] = bytes([p]) + row.tobytes()
    return out


def bit_planes(codes: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, planes) for rows of one shape: planes is rows x planes x bytes."""
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, code in enumerate(codes):
        shapes.setdefault((code[0], (len(code) - 1) // code[0]), []).append(i)
    return [(np.array(rows), np.frombuffer(b"".join(codes[i] for i in rows), np.uint8).reshape(len(rows), -1)[:, 1:].reshape(len(rows), p, g)) for (p, g), rows in shapes.items()]


def decode(codes: list[bytes]) -> np.ndarray:
    """The integer vectors of all codes, filled up with zeros to one length."""
    shapes = bit_planes(codes)
    out = np.zeros((len(codes), 8 * max((p.shape[2] for _, p in shapes), default=0)), np.int64)
    for rows, planes in shapes:
        bits = np.unpackbits(planes, axis=2, bitorder="little").astype(np.int64)
        weight = np.left_shift(np.int64(1), np.arange(planes.shape[1], dtype=np.int64))
        weight[-1] = -weight[-1]
        out[rows, : bits.shape[2]] = (bits * weight[:, None]).sum(axis=1)
    return out


def subset_sums(x: np.ndarray) -> np.ndarray:
    """groups x 256 x anchors: for every eight dimensions the sums of all their subsets."""
    n, d = x.shape
    out = np.zeros((d // 8, 256, n), np.int64)
    for j in range(8):
        out[:, 1 << j : 2 << j] = out[:, : 1 << j] + x[:, j::8].T[:, None, :]
    return out


def scores(tables: np.ndarray, codes: list[bytes]) -> np.ndarray:
    """anchors x rows: inner products. Each byte of a plane looks its sum up in the tables; the planes' sums are shifted and added, the sign plane is subtracted."""
    out = np.zeros((len(codes), tables.shape[2]), np.int64)
    for rows, planes in bit_planes(codes):
        n, p, g = planes.shape
        for a in range(0, n, STEP):
            part = np.zeros((len(rows[a : a + STEP]), tables.shape[2]), np.int64)
            for i in reversed(range(p)):
                part <<= 1
                for group in range(min(g, len(tables))):
                    found = tables[group][planes[a : a + STEP, i, group]]
                    part += -found if i == p - 1 else found
            out[rows[a : a + STEP]] = part
    return np.ascontiguousarray(out.T)


class Cell:
    """One block of anchors, past which rows are streamed; it keeps the first `k` rows of every list of every anchor."""

    def __init__(self, key: tuple, anchors: list[dict], k: int, low: int, high: int):
        self.key, self.anchors, self.k, self.low, self.high = key, anchors, k, low, high
        self.tables = subset_sums(decode([a["planes"] for a in anchors]))
        self.lists: dict[tuple[int, int], list[np.ndarray]] = {}
        # Positives only come from the anchors' labels; negatives from all rows.
        own = np.array([a["label"] for a in anchors])
        every = {None: np.arange(len(own))} if anchors[0]["asked"] is not None else {k: np.flatnonzero(own == k) for k in np.unique(own).tolist()}
        self.parts = [(label, which, self.tables if label is None else self.tables[:, :, which]) for label, which in every.items()]

    def keep(self, list_of: tuple[int, int], found: list[np.ndarray]) -> None:
        """Merge rows (score, no id, id, copies) into a list; higher scores first, then smaller ids, rows without an id last."""
        have = self.lists.get(list_of)
        if have is not None:
            found = [np.concatenate(x) for x in zip(have, found)]
        order = np.lexsort((found[2], found[1], -found[0]))[: self.k]
        self.lists[list_of] = [x[order] for x in found]

    def add(self, rows: pa.RecordBatch) -> None:
        codes = rows.column("planes").to_pylist()
        none = np.asarray(rows.column("id").is_null())
        ids, labels, copies = (rows.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("id", "label", "m"))
        for label, which, tables in self.parts:
            use = np.arange(len(codes)) if label is None else np.flatnonzero(labels == label)
            if len(use):
                found = scores(tables, [codes[i] for i in use.tolist()])
                for a, row in zip(which.tolist(), found):
                    (self.negatives if label is None else self.positives)(a, row, use, codes, ids, none, labels, copies)

    def positives(self, a, row, use, codes, ids, none, labels, copies) -> None:
        anchor, have = self.anchors[a], self.lists.get((a, 0))
        near = np.arange(len(use)) if have is None or len(have[0]) < self.k else np.flatnonzero(row >= have[0][-1])
        rows, score = use[near], row[near]
        m = copies[rows].copy()
        # A row is not its own positive; its copies are.
        for i in np.flatnonzero(none[rows] if anchor["id"] is None else (ids[rows] == anchor["id"]) & ~none[rows]).tolist():
            m[i] -= codes[rows[i]] == anchor["planes"]
        left = m > 0
        if left.any():
            self.keep((a, 0), [score[left], none[rows][left], ids[rows][left], m[left]])

    def negatives(self, a, row, use, codes, ids, none, labels, copies) -> None:
        anchor = self.anchors[a]
        other = labels != anchor["label"]
        for ask in anchor["asked"]:
            p = ask["score"]
            if p < 0:
                continue  # low * p > high * p: nothing lies between
            at = np.flatnonzero(other & (100 * row >= self.low * p) & (100 * row <= self.high * p))
            have = self.lists.get((a, ask["j"]))
            if have is not None and len(have[0]) == self.k:
                at = at[row[at] >= have[0][-1]]
            if len(at):
                self.keep((a, ask["j"]), [row[at], none[at], ids[at], copies[at]])

    def result(self) -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        for (a, j), (score, none, ids, m) in self.lists.items():
            columns[0] += [self.anchors[a]["a"]] * len(ids)
            columns[1] += [j] * len(ids)
            columns[2] += [None if n else i for n, i in zip(none.tolist(), ids.tolist())]
            columns[3] += score.tolist()
            columns[4] += m.tolist()
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["a", "j", "id", "score", "m"])


def met(anchors: DataFrame, rows: DataFrame, blocks: int, slices: int, k: int, low: int, high: int) -> DataFrame:
    """(a, j, id, score, m): every block of anchors meets every slice of rows in one cell, which keeps its first rows of every list."""
    left = anchors.select(F.pmod("a", F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s"), F.lit(0).alias("kind"), "a", "id", "label", "planes", "m", "asked")
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.pmod("a", F.lit(slices)).cast("int").alias("s"), F.lit(1).alias("kind"), "a", "id", "label", "planes", "m", F.lit(None).cast("array<struct<j:int,score:bigint>>").alias("asked"))
    cells = left.unionByName(right).repartitionById(min(blocks * slices, 4096), F.pmod(F.col("b") * slices + F.col("s"), F.lit(min(blocks * slices, 4096))).cast("int"))

    def meet(batches):
        anchors: list[dict] = []
        key, cell = None, None
        for batch in batches:
            b, s, kind = (batch.column(c).to_numpy() for c in ("b", "s", "kind"))
            cuts = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (s[1:] != s[:-1]) | (kind[1:] != kind[:-1])))
            for at, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(b)]):
                if key != (b[at], s[at]):
                    if cell:
                        yield cell.result()
                    key, cell, anchors = (b[at], s[at]), None, []
                if kind[at] == 0:
                    anchors += batch.slice(at, end - at).to_pylist()
                elif anchors:
                    cell = cell or Cell(key, anchors, k, low, high)
                    for i in range(at, end, CHUNK):
                        cell.add(batch.slice(i, min(CHUNK, end - i)))
        if cell:
            yield cell.result()

    return cells.sortWithinPartitions("b", "s", "kind").mapInArrow(meet, "a long, j int, id long, score long, m long")


def hard_negatives(spark: SparkSession, vectors: DataFrame, anchor: Column, *, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label", scale: float = 256,
                   positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every anchor row its first `positives` other rows of the same label, and for each of
    them the first `negatives` rows of other labels whose score is between `low` and `high` per cent of the positive's.

    A component counts as floor(scale * x), the score is the exact inner product of two such vectors; higher scores come first, ties by smaller id.
    Scores have to fit a long with two digits to spare; a component beyond 2^62 is an error.

    1. Vectors become bit planes, one byte for eight dimensions, a tenth to a third of their size; equal rows become one with a count. 2. Blocks of ANCHORS anchors
    meet slices of rows in cells: a task builds the tables of subset sums of its anchors and streams the rows past them, so its memory does not depend
    on the number of rows, and it passes on its first rows of each list only. 3. A first pass finds the positives (rows of the anchors' labels), a second one the negatives inside
    the bands that these give. All rows are scored; there is no index and no candidate limit.

    Rows with a null label, a null vector, or null or non-finite entries take no part. A null id comes last among ties and is never an anchor by itself (a null condition is false).
    Rows that are equal as a whole count as often as they occur, as anchors, positives and negatives; a row is not its own positive. Shorter vectors are filled up with zeros, an empty
    one scores 0 everywhere. An empty table, no anchors, or anchors without positives give no rows. Other columns are not read.
    """
    folder = scratch_dir(spark, "hard-negatives")
    taken = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vec).alias("v"), F.coalesce(anchor, F.lit(False)).alias("asks"))

    def rows(batches):
        for batch in batches:
            column = batch.column("v")
            column = column.cast(pa.list_(column.type.value_type))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(encode(column, scale), pa.binary()), batch.column("asks")], names=["id", "label", "planes", "asks"])

    coded = taken.where("label IS NOT NULL AND v IS NOT NULL").mapInArrow(rows, "id long, label long, planes binary, asks boolean").where("planes IS NOT NULL")
    coded = coded.groupBy("id", "label", "planes", "asks").agg(F.count("*").alias("m")).withColumn("a", F.xxhash64("id", "label", "planes"))
    coded = write_table(coded, f"{folder}/rows")
    size = coded.agg(F.count("*").alias("rows"), F.count_if("asks").alias("anchors")).first()
    blocks, slices = max(1, math.ceil(size["anchors"] / ANCHORS)), max(LEAST_SLICES, math.ceil(size["rows"] / ROWS))
    own = coded.where("asks")
    # Equal rows of which only some ask (a condition on other columns) are one candidate.
    everything = write_table(coded.groupBy("a", "id", "label", "planes").agg(F.sum("m").alias("m")), f"{folder}/candidates")
    near = met(own.withColumn("asked", F.lit(None).cast("array<struct<j:int,score:bigint>>")), everything, blocks, slices, positives, low, high)
    best = Window.partitionBy("a").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    each = near.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("m", F.lit(positives)).cast("int"))))
    first = each.withColumn("j", F.row_number().over(best)).where(F.col("j") <= positives).select("a", "j", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    first = write_table(first, f"{folder}/positives")
    asked = first.groupBy("a").agg(F.collect_list(F.struct("j", F.col("positive_score").alias("score"))).alias("asked"))
    asked = write_table(own.join(asked, "a"), f"{folder}/asked")
    far = met(asked, everything, blocks, slices, negatives, low, high)
    each = far.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("m", F.lit(negatives)).cast("int"))))
    order = Window.partitionBy("a", "j").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    each = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select("a", "j", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = each.join(first, ["a", "j"]).join(own.select("a", F.col("id").alias("anchor_id"), F.col("m").alias("times")), "a")
    out = out.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
