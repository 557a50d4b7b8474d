"""Benchmark passages in a corpus: a positional inverted index of the rarest benchmark terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.graph import write_table
from tidemark.llm.textarrays import ALPHANUMERIC, slices, word_hashes, words
from tidemark.session import scratch_dir

#: Characters of benchmark text whose vocabulary travels with a task; a larger benchmark is looked up in several blocks.
BLOCK_CHARS = 8_000_000
ITEMS = "item long, item_id string, words array<long>"
OUT = "doc_id long, text_hash long, n_words long, n_hit long, items array<string>"


def _hashed(batch: pa.RecordBatch, column: str):
    """(first row, words per text, word hashes) of each slice."""
    for a, b, data, borders in slices(batch, column):
        mapped, starts, ends, counts = words(data, borders, ALPHANUMERIC)
        yield a, counts, word_hashes(mapped, starts, ends).view(np.int64)


def item_table(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """ITEMS: one row per distinct item with words; `item` numbers it by content, its words are hashes."""

    def rows(batches):
        for batch in batches:
            for a, counts, hashes in _hashed(batch, "text"):
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(hashes))
                part = [c.slice(a, len(counts)) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*part, lists], names=["item", "item_id", "words"])

    chosen = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text")).distinct()
    chosen = chosen.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")
    return chosen.mapInArrow(rows, ITEMS).where(F.size("words") > 0)


def term_counts(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each term of a sorted, bounded vocabulary occurs in all documents."""

    def rows(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, _, hashes in _hashed(batch, "text"):
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                total += np.bincount(at[vocabulary[at] == hashes], minlength=len(vocabulary))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["term", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for row in docs.select("text").mapInArrow(rows, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return out


def anchors(items: DataFrame, vocabulary: np.ndarray, counts: np.ndarray, window: int) -> DataFrame:
    """(term, item, item_pos, needed): where the two rarest terms of each window stand; `needed` of them have to agree in a document."""

    def rows(batches):
        for batch in batches:
            out = []
            for item, own in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist()):
                own = np.array(own, np.int64)
                rarity = counts[np.searchsorted(vocabulary, own)] * len(own) + np.arange(len(own))
                k = min(window, len(own))
                frames = np.lib.stride_tricks.sliding_window_view(rarity, k)
                two = np.argsort(frames, axis=1)[:, :2] + np.arange(len(frames))[:, None]
                out += [(int(own[p]), item, p, min(2, k)) for p in np.unique(two).tolist()]
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["term", "item", "item_pos", "needed"])

    return items.select("item", "words").mapInArrow(rows, "term long, item long, item_pos int, needed int")


def postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(term, doc_id, text_hash, pos): the positional index of the documents for a sorted list of terms."""

    def rows(batches):
        for batch in batches:
            for a, counts, hashes in _hashed(batch, "text"):
                at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                hit = np.flatnonzero(terms[at] == hashes)
                text_of = np.repeat(np.arange(len(counts)), counts)[hit]
                first = np.cumsum(counts) - counts
                keys = [batch.column(c).take(pa.array(text_of + a)) for c in ("doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[hit]), *keys, pa.array((hit - first[text_of]).astype(np.int32))], names=["term", "doc_id", "text_hash", "pos"])

    return docs.select("doc_id", "text_hash", "text").mapInArrow(rows, "term long, doc_id long, text_hash long, pos int")


def aligned(docs: DataFrame, items: DataFrame, window: int) -> DataFrame | None:
    """(doc_id, text_hash, item, shift, item_pos): every posting of a rare term, moved by the term's place in the item; equal shifts mean one alignment."""
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-total * 8 // BLOCK_CHARS) or 1
    out = None
    for block in range(blocks):
        some = items.where(F.pmod("item", F.lit(blocks)) == block) if blocks > 1 else items
        vocabulary = np.array(sorted(r[0] for r in some.select(F.explode("words")).distinct().collect()), np.int64)
        if not len(vocabulary):
            continue
        rare = anchors(some, vocabulary, term_counts(docs, vocabulary), window)
        terms = np.array(sorted(r[0] for r in rare.select("term").distinct().collect()), np.int64)
        part = postings(docs, terms).join(rare, "term").select("doc_id", "text_hash", "item", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_pos", "needed")
        out = part if out is None else out.unionByName(part)
    return out


def _overlaps(own: np.ndarray, item: np.ndarray, shift: int, window: int) -> np.ndarray | None:
    """Document positions inside windows that agree with the item at this shift."""
    a, b = max(shift, 0), min(len(own), shift + len(item))
    k = min(window, len(item))
    if b - a < k:
        return None
    same = np.append(0, np.cumsum(own[a:b] == item[a - shift : b - shift]))
    starts = np.flatnonzero(same[k:] - same[:-k] == k)
    return (starts[:, None] + np.arange(a, a + k)).ravel() if len(starts) else None


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """OUT per document: its words, words inside any occurrence of a benchmark window, and the items such windows come from.

    1. Frequencies of the benchmark's terms over all documents. 2. Each window's two rarest terms become anchors; the positional index keeps anchors only.
    3. Posting lists meet by term and are moved by the anchor's place; alignments (document, item, shift) on which at least two anchors agree stay: the
    intersection of offset-adjusted lists. 4. A window that occurs whole has both its anchors on one alignment, so comparing the words along the remaining
    alignments gives exactly the occurrences. Frequent passages give one alignment per occurrence, and no pairs of documents arise.

    An item of fewer than `window` words is one window; without words (or null) it is none. Null texts have no words. Rows with equal or null doc_id are
    each judged by their own text, at a cost that grows with their number. Long texts are read whole, an empty table gives no rows. Repeated items count once. A null item_id is listed as null. Other columns are not read.
    """
    folder = scratch_dir(spark, "decontaminate")
    items = write_table(item_table(benchmark, item_id, item_text), f"{folder}/items")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    lists = aligned(docs, items, window)
    if lists is None:
        found = spark.createDataFrame([], "found_id long, found_hash long, hits array<struct<item_id:string,shifts:array<int>,words:array<bigint>>>")
    else:
        # Rows are told apart by id and text, so many rows without an id, or with one id, share nothing but equal texts, whose hits are one.
        met = lists.groupBy("doc_id", "text_hash", "item", "shift").agg(F.min("item_pos").alias("low"), F.max("item_pos").alias("high"), F.first("needed").alias("needed"))
        met = met.where((F.col("needed") == 1) | (F.col("low") < F.col("high"))).groupBy("doc_id", "text_hash", "item").agg(F.collect_list("shift").alias("shifts")).join(items, "item")
        found = met.groupBy(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash")).agg(F.collect_list(F.struct("item_id", "shifts", "words")).alias("hits"))

    def judge(batches):
        for batch in batches:
            for a, counts, hashes in _hashed(batch, "text"):
                n_hit, listed = [], []
                keys = [batch.column(c).slice(a, len(counts)) for c in ("doc_id", "text_hash")]
                hits = batch.column("hits").slice(a, len(counts)).to_pylist()
                end = 0
                for n, own_hits in zip(counts.tolist(), hits):
                    own, end = hashes[end : end + n], end + n
                    inside, of = np.zeros(n, bool), set()
                    for h in own_hits or ():
                        item = np.array(h["words"], np.int64)
                        for shift in h["shifts"]:
                            at = _overlaps(own, item, shift, window)
                            if at is not None:
                                inside[at] = True
                                of.add(h["item_id"])
                    n_hit.append(int(inside.sum()))
                    listed.append(sorted(of, key=lambda x: (x is None, x or "")))
                yield pa.RecordBatch.from_arrays([*keys, pa.array(counts), pa.array(n_hit, pa.int64()), pa.array(listed, pa.list_(pa.string()))], names=["doc_id", "text_hash", "n_words", "n_hit", "items"])

    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash"))
    return docs.join(found, same, "left").select("doc_id", "text_hash", "text", "hits").mapInArrow(judge, OUT)
