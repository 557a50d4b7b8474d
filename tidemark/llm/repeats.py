"""Repeated byte strings across all documents: suffixes meet at anchors, and shards are merged by refining their interleave byte by byte."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.graph import write_table
from tidemark.llm.textarrays import prefix, slices, spans_hash
from tidemark.session import scratch_dir

#: Bytes of an anchor, and rows of one merge; larger groups of different surroundings are compared by window digests.
ANCHOR, MERGE_ROWS = 64, 20_000
SEGMENT = "doc_id long, text_hash long, anchor long, digest binary, start long, n int, rel int"
CUT = "anchor long, digest binary, rel int, bytes binary"


def anchors_of(data: np.ndarray, borders: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, windows, anchor places, anchor hashes): runs of windows of `length` bytes that share their anchor.

    A window's anchor is the first of its ANCHOR-byte strings with the smallest hash, so equal windows have equal anchors at equal places.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.view(np.uint64)
    begins = np.arange(len(data) - ANCHOR + 1)
    hashes = spans_hash(prefix(data), begins, begins + ANCHOR)
    bits = np.uint64(max(24, len(data).bit_length()))
    keys = hashes >> bits << bits | begins.astype(np.uint64)
    k = length - ANCHOR + 1
    padded = np.full(-(-len(keys) // k) * k, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, k)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - length + 1
    place = (np.minimum(behind[:n], ahead[k - 1 : k - 1 + n]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    last = np.repeat(borders[1:], np.diff(borders))[:n] - length  # last window start of the text each byte belongs to
    inside = np.arange(n) <= last
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | ~inside[:-1] | (last[1:] != last[:-1])
    starts = np.flatnonzero(new & inside)
    if not len(starts):
        return none, none, none, none.view(np.uint64)
    run = np.cumsum(new & inside)[inside] - 1
    return starts, np.bincount(run, minlength=len(starts)), place[starts], hashes[place[starts]]


def segments(docs: DataFrame, length: int) -> DataFrame:
    """SEGMENT per run of windows with one anchor: its first window, how many, where its anchor is, and a digest of its bytes."""

    def rows(batches):
        for batch in batches:
            for a, _, data, borders in slices(batch, "text"):
                starts, n, place, hashes = anchors_of(data, borders, length)
                if not len(starts):
                    continue
                text = np.searchsorted(borders, starts, "right") - 1
                view = memoryview(data.tobytes())
                ends = starts + n - 1 + length
                digests = [hashlib.blake2b(view[s:e], digest_size=16).digest() for s, e in zip(starts.tolist(), ends.tolist())]
                take = pa.array(text + a)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(take), batch.column("text_hash").take(take), pa.array(hashes.view(np.int64)), pa.array(digests, pa.binary()),
                    pa.array(starts - borders[text]), pa.array(n.astype(np.int32)), pa.array((place - starts).astype(np.int32)),
                ], names=["doc_id", "text_hash", "anchor", "digest", "start", "n", "rel"])

    return docs.mapInArrow(rows, SEGMENT)


def refine(columns: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Intervals of rows that agree in their group and first k bytes, for every k: (rows, bytes + 1) of interval numbers, -1 where a row stands alone.

    Rows keep the interleave of all shards; one more byte splits each interval in a stable pass over its rows, and intervals of one row leave. The depth
    at which two rows part is their common prefix. `columns` is -1 where a row has no byte.
    """
    n, depth = columns.shape
    out = np.full((n, depth + 1), -1, np.int32)
    rows = np.argsort(group, kind="stable")
    key = group[rows].astype(np.int64)
    for k in range(depth + 1):
        new = np.ones(len(rows), bool)
        new[1:] = key[1:] != key[:-1]
        size = np.diff(np.append(np.flatnonzero(new), len(rows)))
        keep = np.repeat(size > 1, size)
        interval = np.cumsum(new) - 1
        rows, interval = rows[keep], interval[keep]
        out[rows, k] = interval
        if k == depth or not len(rows):
            break
        byte = columns[rows, k].astype(np.int64)
        here = byte >= 0
        rows, key = rows[here], interval[here].astype(np.int64) * 256 + byte[here]
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
    return out


def repeated_windows(parts: list[bytes], rels: list[int], group: np.ndarray, length: int) -> np.ndarray:
    """(parts, places): whether another part of the group has the window whose anchor lies `place` bytes after its start."""
    n, places = len(parts), length - ANCHOR + 1
    right, left = np.full((n, length), -1, np.int16), np.full((n, places - 1), -1, np.int16)
    for i, (part, rel) in enumerate(zip(parts, rels)):
        raw = np.frombuffer(part, np.uint8)
        tail, head = raw[rel : rel + length], raw[:rel][::-1]
        right[i, : len(tail)] = tail
        left[i, : len(head)] = head
    ahead, back = refine(right, group), refine(left, group)
    out = np.zeros((n, places), bool)
    for o in range(places):
        rows = np.flatnonzero((back[:, o] >= 0) & (ahead[:, length - o] >= 0))
        if not len(rows):
            continue
        key = back[rows, o].astype(np.int64) << 32 | ahead[rows, length - o]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twin = np.append(same, False) | np.append(False, same)
        out[rows[order[twin]], o] = True
    return out


def _ranges(flags: np.ndarray, rel: int) -> list[dict]:
    """Runs of repeated windows by their number in the segment; window j has its anchor rel - j bytes after its start."""
    j = np.sort(rel - np.flatnonzero(flags))
    if not len(j):
        return []
    cut = np.flatnonzero(np.diff(j) > 1) + 1
    return [{"first": int(part[0]), "last": int(part[-1])} for part in np.split(j, cut)]


def merged(parts: DataFrame, length: int) -> DataFrame:
    """(anchor, digest, windows): for parts (CUT) of anchors with at most MERGE_ROWS different ones, the runs of windows that another part has too."""

    def rows(batches):
        waiting: list[tuple] = []

        def done():
            codes = np.unique([w[0] for w in waiting], return_inverse=True)[1]
            flags = repeated_windows([w[3] for w in waiting], [w[2] for w in waiting], codes, length)
            found = [(w[0], w[1], _ranges(f, w[2])) for w, f in zip(waiting, flags)]
            found = [x for x in found if x[2]]
            columns = list(zip(*found)) or [[], [], []]
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["anchor", "digest", "windows"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(waiting) >= 2048 and row[0] != waiting[-1][0]:
                    yield done()
                    waiting = []
                waiting.append(row)
        if waiting:
            yield done()

    parts = parts.select("anchor", "digest", "rel", "bytes").repartition("anchor").sortWithinPartitions("anchor", "digest")
    return parts.mapInArrow(rows, "anchor long, digest binary, windows array<struct<first:int,last:int>>")


def digested(parts: DataFrame, length: int) -> DataFrame:
    """As merged(), for anchors of any number of parts: equal windows are found by a 128-bit digest each, which spreads one anchor over all tasks."""

    def rows(batches):
        for batch in batches:
            for anchor, digest, _, part in zip(*(c.to_pylist() for c in batch.columns)):
                view = memoryview(part)
                own = [hashlib.blake2b(view[j : j + length], digest_size=16).digest() for j in range(len(part) - length + 1)]
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array([anchor] * n), pa.array([digest] * n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(own, pa.binary())], names=["anchor", "digest", "window", "key"])

    windows = parts.select("anchor", "digest", "rel", "bytes").mapInArrow(rows, "anchor long, digest binary, window int, key binary")
    twice = windows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    return windows.join(twice, "key").groupBy("anchor", "digest").agg(F.transform(F.collect_list("window"), lambda j: F.struct(j.alias("first"), j.alias("last"))).alias("windows"))


def repeated_spans(spark: SparkSession, docs: DataFrame, length: int = 400, merge_rows: int = MERGE_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (maximal runs of bytes to remove: start, end), kept (the other bytes).

    A byte goes if a string of `length` bytes over it starts anywhere else, in its own text too; strings never cross texts and are judged on the input.

    1. Every window has an anchor (see anchors_of); runs of windows with one anchor form a segment, about two a window length. 2. Only segments whose
    anchor occurs again can hold repeated windows; equal segments form a class, and every window of a class of two or more is repeated. 3. Anchors with
    several classes: one row of bytes per class, from all shards, is merged by refining their interleave away from the anchor, to the right and to
    the left; intervals of rows that agree to both sides over `length` bytes in sum are the repeated windows. Corpus size only decides how many such
    independent merges there are; a frequent passage adds one row per different surrounding, and beyond `merge_rows` of them windows are compared by digest.
    4. Windows go back to their texts as byte ranges.

    Null text: empty. Texts shorter than `length` keep everything. Equal rows repeat each other; rows with the same or null doc_id are told apart by
    a hash of the text. Other columns are not read.
    """
    folder = scratch_dir(spark, "repeats")
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = write_table(segments(keyed.where(F.octet_length("text") >= length), length), f"{folder}/segments")
    # Small sides are written before they are joined: two plain shuffles can be split where one anchor has very many segments (periodic texts).
    again = write_table(found.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), f"{folder}/again")
    repeated = write_table(found.join(again, "anchor", "left_semi"), f"{folder}/repeated")
    one = F.min(F.struct("doc_id", "text_hash", "start", "n", "rel")).alias("one")
    classes = write_table(repeated.groupBy("anchor", "digest").agg(F.count("*").alias("size"), one), f"{folder}/classes")
    mixed = write_table(classes.groupBy("anchor").agg(F.count("*").alias("classes"), F.min("size").alias("least")).where("classes > 1 AND least = 1"), f"{folder}/mixed")
    asked = classes.join(mixed, "anchor").select("anchor", "digest", "classes", "one.*")
    asked = asked.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_list(F.struct("anchor", "digest", "classes", "rel", "start", "n")).alias("asked"))
    of_text = keyed.join(asked, keyed["doc_id"].eqNullSafe(asked["d"]) & (F.col("text_hash") == F.col("h"))).select("text", "asked")

    def cut(batches):
        for batch in batches:
            for body, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = body.encode()
                parts = [raw[w["start"] : w["start"] + w["n"] - 1 + length] for w in wanted]
                kinds = (("anchor", pa.int64()), ("digest", pa.binary()), ("rel", pa.int32()), ("classes", pa.int64()))
                yield pa.RecordBatch.from_arrays([*[pa.array([w[k] for w in wanted], t) for k, t in kinds], pa.array(parts, pa.binary())], names=["anchor", "digest", "rel", "classes", "bytes"])

    parts = write_table(of_text.mapInArrow(cut, "anchor long, digest binary, rel int, classes long, bytes binary").dropDuplicates(["anchor", "digest"]), f"{folder}/parts")
    shared = merged(parts.where(F.col("classes") <= merge_rows), length)
    large = parts.where(F.col("classes") > merge_rows)
    if not large.isEmpty():
        shared = shared.unionByName(digested(large, length))
    shared = write_table(shared, f"{folder}/shared")
    # One row per class that goes, in full or in part.
    going = write_table(classes.select("anchor", "digest", "size").join(shared, ["anchor", "digest"], "left").where("size > 1 OR windows IS NOT NULL"), f"{folder}/going")
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("n") - 1).alias("last")))
    ranges = repeated.join(going, ["anchor", "digest"]).select(
        "doc_id", "text_hash", F.transform(F.when(F.col("size") > 1, whole).otherwise(F.col("windows")), lambda w: F.struct((F.col("start") + w["first"]).alias("start"), (F.col("start") + w["last"] + length).alias("end"))).alias("ranges"))
    per_text = ranges.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.flatten(F.collect_list("ranges")).alias("ranges"))

    def remove(batches):
        for batch in batches:
            spans, kept, sizes = [], [], []
            for body, own in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                raw = body.encode()
                out: list[dict] = []
                for r in sorted(own or (), key=lambda r: (r["start"], r["end"])):
                    if out and r["start"] <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], r["end"])
                    else:
                        out.append(r)
                ends = [0, *[r["end"] for r in out]]
                kept.append(b"".join(raw[a:b] for a, b in zip(ends, [*[r["start"] for r in out], len(raw)])))
                spans.append(out)
                sizes.append(len(raw))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    joined = keyed.join(per_text, keyed["doc_id"].eqNullSafe(per_text["d"]) & (F.col("text_hash") == F.col("h")), "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(remove, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
