"""Repeated word passages: Rabin-Karp hashes of word windows, counted in Spark; later copies of repeated windows merge into removal intervals."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.graph import write_table
from tidemark.llm.textarrays import STEP, prefix, slices, spans_hash, words
from tidemark.session import scratch_dir

#: Words of a group that names a run of windows; every window holds many such groups.
GROUP = 8
#: The second hash of a window runs over this base.
SECOND = 0x9FB21C651E98DF25
#: Rank of a document without an id: behind all others.
LAST = (1 << 63) - 1
#: Every byte that is not an ASCII blank belongs to a word.
WORD_BYTES = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)], np.uint8)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts): the words one after the other, one blank behind each."""
    sizes = ends - starts + 1
    begins = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), 32, np.uint8)
    here = np.flatnonzero(WORD_BYTES[data])
    out[here + np.repeat(begins - starts, sizes - 1)] = data[here]
    return out, begins


def runs_of_windows(hashes: np.ndarray, borders: np.ndarray, length: int, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, windows, places): runs of windows of `length` words that hold the same smallest hash of `group` words, the first one of equal ones.

    `hashes` has one value for each word that starts a group; equal windows have equal smallest hashes at equal places, so runs that share
    a window share their hash.
    """
    none = np.zeros(0, np.int64)
    total = int(borders[-1])
    if total < length:
        return none, none, none
    bits = np.uint64(max(24, total.bit_length()))
    at = np.arange(len(hashes), dtype=np.uint64)
    keys = hashes >> bits << bits | at
    k, n = length - group + 1, total - length + 1
    padded = np.full(-(-len(keys) // k) * k, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, k)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[:n], ahead[k - 1 : k - 1 + n]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    end = np.repeat(borders[1:], np.diff(borders))[:n]
    inside = np.arange(n) + length <= end
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | (end[1:] != end[:-1])
    starts = np.flatnonzero(new & inside)
    if not len(starts):
        return none, none, none
    run = np.cumsum(new & inside)[inside] - 1
    return starts, np.bincount(run, minlength=len(starts)), place[starts]


def sections(docs: DataFrame, length: int, group: int) -> DataFrame:
    """(rank, text_hash, name, digest, start, n): each text's runs of windows; `name` is the hash they share, `digest` stands for all their words."""

    def rows(batches):
        for batch in batches:
            for a, _, data, borders in slices(batch, "text"):
                _, starts, ends, counts = words(data, borders, WORD_BYTES)
                limits = np.concatenate([[0], np.cumsum(counts)])
                if len(starts) < length:
                    continue
                sums = prefix(spans_hash(prefix(data), starts, ends))
                first = np.arange(len(starts) - group + 1)
                hashes = spans_hash(sums, first, first + group)
                begin, n, place = runs_of_windows(hashes, limits, length, group)
                if not len(begin):
                    continue
                plain, at = joined(data, starts, ends)
                view = memoryview(plain.tobytes())
                stop = np.append(at, len(plain))[begin + n - 1 + length]
                digests = [hashlib.blake2b(view[s:e], digest_size=16).digest() for s, e in zip(at[begin].tolist(), stop.tolist())]
                text = np.searchsorted(limits, begin, "right") - 1
                take = pa.array(text + a)
                yield pa.RecordBatch.from_arrays([
                    batch.column("rank").take(take), batch.column("text_hash").take(take), pa.array(hashes[place].view(np.int64)), pa.array(digests, pa.binary()),
                    pa.array((begin - limits[text]).astype(np.int32)), pa.array(n.astype(np.int32)),
                ], names=["rank", "text_hash", "name", "digest", "start", "n"])

    return docs.select("rank", "text_hash", "text").mapInArrow(rows, "rank long, text_hash long, name long, digest binary, start int, n int")


def windows(texts: DataFrame, length: int) -> DataFrame:
    """(name, digest, window, low, h1, h2): both Rabin-Karp hashes of every window of the asked sections (text, asked)."""

    def rows(batches):
        for batch in batches:
            lists = batch.column("asked")
            first = np.asarray(lists.offsets)
            flat = lists.flatten()
            start, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n"))
            first = first - first[0]
            for a, e, data, borders in slices(batch, "text"):
                _, s, t, counts = words(data, borders, WORD_BYTES)
                limits = np.cumsum(counts) - counts
                own = np.arange(first[a], first[e])
                text = np.repeat(np.arange(e - a), np.diff(first[a : e + 1]))
                size = n[own]
                section = np.repeat(own, size)
                inner = np.arange(len(section)) - np.repeat(np.cumsum(size) - size, size)
                at = np.repeat(limits[text] + start[own], size) + inner
                hashes = spans_hash(prefix(data), s, t)
                one, two = (spans_hash(prefix(hashes, b), at, at + length, b).view(np.int64) for b in (int(STEP), SECOND))
                take = pa.array(section)
                yield pa.RecordBatch.from_arrays([flat.field("name").take(take), flat.field("digest").take(take), pa.array(inner.astype(np.int32)), flat.field("low").take(take), pa.array(one), pa.array(two)],
                                                 names=["name", "digest", "window", "low", "h1", "h2"])

    return texts.select("text", "asked").mapInArrow(rows, "name long, digest binary, window int, low long, h1 long, h2 long")


def kept_words(batches):
    for batch in batches:
        counts, spans, kept = [], [], []
        for body, own in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
            found = body.encode().split()  # ASCII blanks, as in WORD_BYTES
            out: list[dict] = []
            for r in sorted(own or (), key=lambda r: (r["start"], r["end"])):
                if out and r["start"] <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], r["end"])
                else:
                    out.append(r)
            counts.append(len(found))
            for r in reversed(out):
                del found[r["start"] : r["end"]]
            kept.append(b" ".join(found).decode())
            spans.append(out)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], names=["doc_id", "n_words", "spans", "kept"])


def repeated_passages(spark: SparkSession, docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, spans (maximal runs of words to remove: start, end, in words), kept (the other words, joined by a blank).

    A word goes if a window of `length` words over it also starts in a document with a smaller id; windows never cross texts and are judged on the
    input, so the first copy of a passage stays.

    Windows are counted in two steps, because one row for each of them is several times the input. 1. A window is named by the smallest hash of GROUP
    consecutive words in it; neighbours with one name form a section, about half a window long, with a digest of all its words. Only names that occur
    in two documents can hold repeated windows. 2. Equal sections are counted as one: all windows of the later ones go. 3. Where a name has different
    sections, every window of one copy of each is hashed (two Rabin-Karp hashes of 64 bits) and counted: windows that an earlier document has too go. 4. Windows
    go back to their texts as word ranges, which are merged there. Counts combine before they are shuffled, so a passage that a third of all documents
    hold costs one row a task and step.

    Null text: no words. Texts with fewer words than `length`, and empty tables, lose nothing. A null id comes after all others. Rows with one id are one
    document and never remove each other's words; they are told apart by a hash of the text. Long texts are read whole. Other columns are not read.
    """
    folder = scratch_dir(spark, "passages")
    group = max(1, min(GROUP, length // 6))
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("rank"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    found = write_table(sections(keyed.where(F.octet_length("text") >= 2 * length - 1), length, group), f"{folder}/sections")
    # Small sides are written before they are joined: two plain shuffles can be split where one name has very many sections.
    again = write_table(found.groupBy("name").agg(F.min("rank").alias("a"), F.max("rank").alias("b")).where("a < b").select("name"), f"{folder}/again")
    repeated = write_table(found.join(again, "name", "left_semi"), f"{folder}/repeated")
    one = F.min(F.struct("rank", "text_hash", "start", "n")).alias("one")
    kinds = write_table(repeated.groupBy("name", "digest").agg(F.max("rank").alias("high"), one), f"{folder}/kinds").withColumn("low", F.col("one.rank"))
    mixed = write_table(kinds.groupBy("name").agg(F.min("low").alias("a"), F.max("low").alias("b")).where("a < b").select("name"), f"{folder}/mixed")
    asked = kinds.join(mixed, "name").select(F.col("low").alias("r"), F.col("one.text_hash").alias("h"), F.struct("name", "digest", "one.start", "one.n", "low").alias("s"))
    asked = write_table(asked.groupBy("r", "h").agg(F.collect_list("s").alias("asked")), f"{folder}/asked")
    of_text = keyed.join(asked, (F.col("rank") == F.col("r")) & (F.col("text_hash") == F.col("h"))).select("text", "asked")
    single = write_table(windows(of_text, length), f"{folder}/windows")
    twice = write_table(single.groupBy("h1", "h2").agg(F.min("low").alias("least"), F.max("low").alias("b")).where("least < b").drop("b"), f"{folder}/twice")
    later = single.join(twice, ["h1", "h2"]).where("low > least").groupBy("name", "digest").agg(F.collect_set("window").alias("windows"))
    going = write_table(kinds.select("name", "digest", "low", "high").join(later, ["name", "digest"], "left").where("high > low OR windows IS NOT NULL"), f"{folder}/going")
    whole = F.array(F.struct(F.col("start").alias("start"), (F.col("start") + F.col("n") - 1 + length).alias("end")))
    some = F.transform("windows", lambda w: F.struct((F.col("start") + w).alias("start"), (F.col("start") + w + length).alias("end")))
    ranges = repeated.join(going, ["name", "digest"]).select("rank", "text_hash", F.explode(F.when(F.col("rank") > F.col("low"), whole).otherwise(some)).alias("range"))
    # A set, because rows that are repeated as a whole bring the same ranges.
    per_text = ranges.groupBy(F.col("rank").alias("r"), F.col("text_hash").alias("h")).agg(F.collect_set("range").alias("ranges"))
    out = keyed.join(per_text, (F.col("rank") == F.col("r")) & (F.col("text_hash") == F.col("h")), "left").select("doc_id", "text", F.col("ranges").cast("array<struct<start:bigint,end:bigint>>").alias("ranges"))
    return out.mapInArrow(kept_words, "doc_id long, n_words long, spans array<struct<start:bigint,end:bigint>>, kept string")
