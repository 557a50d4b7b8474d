"""What a part of the texts does inside its task for :func:`tidemark.operators.terms.tfidf`: terms as numbers, counts by sorting, messages to the tasks that add up.

A part's words are numbered in binary order, a term is ``first * (words + 1) + second + 1`` (second -1: a single word). A blank sorts before every
character of a word, so terms in the order of their numbers are terms in the order of their strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array

#: Numbers of words stay below, so that a pair of them is one number.
WORDS = 1 << 31
#: Rows of one batch that goes back to Spark.
BATCH = 1 << 16
#: Messages in Spark's and in Arrow's words.
SENT_WORDS, NUMBERED_WORDS, SENT_PAIRS, ADDED_PAIRS = (
    "_part int, _bucket int, words string, rows binary", "_part int, _bucket int, ids binary, df binary",
    "_part int, _bucket int, first binary, second binary, rows binary", "_part int, _bucket int, df binary")
ARROW = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def table(columns: dict, spark: str) -> pa.Table:
    return pa.table(columns, pa.schema([(name, ARROW[kind]) for name, kind in (field.split() for field in spark.split(", "))]))


def pack(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first: high bytes that are zero, or all counts that are 1, then vanish when Spark compresses a shuffle."""
    return np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def numbered(values: pa.ChunkedArray, *, nulls: str = "mask") -> tuple[pa.Array, np.ndarray]:
    """Different values, in the order they are met, and the number of each value."""
    coded = pc.dictionary_encode(values, null_encoding=nulls).unify_dictionaries()
    if not coded.num_chunks:
        return pa.array([], values.type), np.zeros(0, np.int64)
    return coded.chunk(0).dictionary, np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks]).astype(np.int64)


def in_order(values: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Different strings in binary order, and the number of each value among them."""
    found, at = numbered(values)
    order = pc.sort_indices(found).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return found.take(pa.array(order)), rank[at]


@dataclass
class Part:
    """Texts of a part, rows of blank-joined words, as numbers."""

    words: pa.Array
    word: np.ndarray  # number of each word of the part's texts
    row: np.ndarray  # its row

    @classmethod
    def of(cls, texts: pa.ChunkedArray) -> Part:
        lists = pc.split_pattern(texts.cast(pa.string()), " ")
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy().astype(np.int64))
        words, word = in_order(pc.list_flatten(lists))
        if len(words) and words[0].as_py() == "":  # a text without words splits into one empty string
            return cls(words[1:], word[word > 0] - 1, row[word > 0])
        return cls(words, word, row)

    def terms(self, bigrams: bool) -> tuple[np.ndarray, np.ndarray]:
        """Number and row of every term, with repeats."""
        base = len(self.words) + 1
        if not bigrams:
            return self.word * base, self.row
        beside = np.flatnonzero(self.row[1:] == self.row[:-1])
        return np.concatenate([self.word * base, self.word[beside] * base + self.word[beside + 1] + 1]), np.concatenate([self.row, self.row[beside]])

    def dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Words in the order they are sent, and where each bucket's begin among them."""
        return dealt((hash_array(self.words.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(buckets)).astype(np.int64), buckets)


def dealt(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def in_rows(terms: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different terms, ascending, and for every row and different term of it: the row, which term, how often."""
    found, at = np.unique(terms, return_inverse=True)
    keys = np.sort(row * max(len(found), 1) + at)
    starts = runs(keys)
    return found, keys[starts] // max(len(found), 1), keys[starts] % max(len(found), 1), np.diff(np.append(starts, len(keys)))


def messages(part: int, starts: np.ndarray, columns: dict[str, Callable[[int, int], object]]) -> dict[str, list]:
    """One row for each bucket that gets something: part, bucket and the columns of its range."""
    sent = [(b, int(lo), int(hi)) for b, (lo, hi) in enumerate(zip(starts[:-1], starts[1:], strict=True)) if hi > lo]
    return {"_part": [part] * len(sent), "_bucket": [b for b, _, _ in sent]} | {k: [f(lo, hi) for _, lo, hi in sent] for k, f in columns.items()}


def sender_of_words(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """A part sends each different word once, with the number of its rows that have it."""
    def send(texts: pa.Table) -> pa.Table:
        part = Part.of(texts["_text"])
        _, _, at, _ = in_rows(part.word, part.row)
        order, starts = part.dealt(buckets)
        words, rows = part.words.take(pa.array(order)).to_pylist(), np.bincount(at, minlength=len(order))[order]
        return table(messages(texts["_part"][0].as_py(), starts, {"words": lambda lo, hi: " ".join(words[lo:hi]), "rows": lambda lo, hi: pack(rows[lo:hi])}), SENT_WORDS)

    return send


def numberer_of_words(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """A bucket numbers its words and adds up their rows; every part gets both for the words it sent, in their order."""
    def number(sent: pa.Table) -> pa.Table:
        lists = pc.split_pattern(sent["words"].cast(pa.string()), " ")
        words, word = in_order(pc.list_flatten(lists))
        total = added(word, sent["rows"].to_pylist(), len(words))
        ids = word * buckets + sent["_bucket"][0].as_py()
        if len(ids) and ids.max() >= WORDS:
            raise OverflowError(f"more than {WORDS} numbers of words")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())[:-1]
        return table({"_part": sent["_part"], "_bucket": sent["_bucket"], "ids": [pack(x) for x in np.split(ids, ends)], "df": [pack(x) for x in np.split(total[word], ends)]}, NUMBERED_WORDS)

    return number


def added(at: np.ndarray, rows: list[bytes], size: int) -> np.ndarray:
    """Sums of the rows that parts have sent, exact up to 2^53."""
    return np.bincount(at, np.concatenate([unpack(x) for x in rows]), size).astype(np.int64)


def answered(column: pa.ChunkedArray, order: np.ndarray) -> np.ndarray:
    """Answers, bucket by bucket, back at what was asked."""
    out = np.empty(len(order), np.int64)
    out[order] = np.concatenate([np.zeros(0, np.int64), *[unpack(x) for x in column.to_pylist()]])
    return out


@dataclass
class Pairs:
    """A part's different pairs of words as pairs of their numbers in the whole table, in the order they are sent."""

    order: np.ndarray
    starts: np.ndarray
    first: np.ndarray
    second: np.ndarray

    @classmethod
    def of(cls, pairs: np.ndarray, ids: np.ndarray, buckets: int) -> Pairs:
        base = len(ids) + 1
        first, second = ids[pairs // base], ids[pairs % base - 1]
        order = np.argsort(first * WORDS + second)
        first, second = first[order], second[order]
        mixed = (first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        placed, starts = dealt((mixed >> np.uint64(33)).astype(np.int64) % buckets, buckets)
        return cls(order[placed], starts, first[placed], second[placed])


def sender_of_pairs(word_buckets: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A part sends each different pair of neighbouring words once, with the number of its rows that have it."""
    def send(texts: pa.Table, words: pa.Table) -> pa.Table:
        part = Part.of(texts["_text"])
        order, _ = part.dealt(word_buckets)
        ids = answered(words.sort_by("_bucket")["ids"], order)
        found, _, at, _ = in_rows(*part.terms(True))
        pair = found % (len(ids) + 1) > 0
        sent, rows = Pairs.of(found[pair], ids, buckets), np.bincount(at, minlength=len(found))[pair]
        rows = rows[sent.order]
        return table(messages(texts["_part"][0].as_py(), sent.starts, {
            "first": lambda lo, hi: pack(np.diff(sent.first[lo:hi], prepend=0)), "second": lambda lo, hi: pack(sent.second[lo:hi]), "rows": lambda lo, hi: pack(rows[lo:hi])}), SENT_PAIRS)

    return send


def adder_of_pairs() -> Callable[[pa.Table], pa.Table]:
    """A bucket adds up the rows of equal pairs; every part gets the sums of those it sent, in their order."""
    def add(sent: pa.Table) -> pa.Table:
        firsts = [np.cumsum(unpack(x)) for x in sent["first"].to_pylist()]
        second = np.concatenate([unpack(x) for x in sent["second"].to_pylist()])
        found, at = np.unique(np.concatenate(firsts) * WORDS + second, return_inverse=True)
        total = added(at, sent["rows"].to_pylist(), len(found))[at]
        ends = np.cumsum([len(x) for x in firsts])[:-1]
        return table({"_part": sent["_part"], "_bucket": sent["_bucket"], "df": [pack(x) for x in np.split(total, ends)]}, ADDED_PAIRS)

    return add


@dataclass
class Heaviest:
    """The ``k`` heaviest terms of a document are asked for, by weights rounded to 12 digits and then by term; terms that contain one of ``boost`` weigh ``factor`` times as much."""

    k: int
    boost: Sequence[str]
    factor: float
    docs: int

    def __call__(self, doc: np.ndarray, term: np.ndarray, n: np.ndarray, total: np.ndarray, df: np.ndarray, names: pa.Array) -> np.ndarray:
        """Which rows can be among them, in a safe choice: Spark rounds and orders what is left.

        Rows are ordered by document. Besides what is heavier than the k-th weight by more than the rounding, terms about as heavy as it stay: of those with equal counts, which weigh
        the same however it is computed, the first ``k`` by term.
        """
        if not len(doc):
            return np.zeros(0, np.int64)
        boosted = np.zeros(len(names), bool)
        for word in self.boost:
            boosted |= pc.match_substring(names, word).to_numpy(zero_copy_only=False)
        hit = boosted[term]
        weight = n / total * np.log((self.docs + 1) / (df + 1)) * np.where(hit, self.factor, 1.0)
        starts = runs(doc)
        size = np.diff(np.append(starts, len(doc)))
        falling = np.lexsort((-weight, doc))
        kth = np.repeat(weight[falling[starts + np.minimum(size, self.k) - 1]], size)
        near = 2e-12 + 1e-14 * np.abs(kth)
        even = np.flatnonzero(np.abs(weight - kth) <= near)
        even = even[np.lexsort((term[even], total[even], n[even], df[even], hit[even], doc[even]))]
        same = np.ones(len(even), bool)
        for x in (doc, n, df, total, hit):
            same[1:] &= x[even][1:] == x[even][:-1]
        same[:1] = False
        at = np.arange(len(even))
        begun = np.maximum.accumulate(np.where(same, 0, at))
        return np.sort(np.concatenate([np.flatnonzero(weight - kth > near), even[at - begun < self.k]]))


def weigher(word_buckets: int, buckets: int, bigrams: bool, several: bool, heaviest: Heaviest | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Every document's different terms with their counts, the number of the document's terms and the rows of the whole table that have the term.

    ``several``: of documents that lie in several parts, else of the others.
    """
    def weigh(texts: pa.Table, answers: pa.Table) -> pa.Table:
        part = Part.of(texts["_text"])
        kind = texts.schema.field("_doc").type
        schema = pa.schema([("doc", {pa.large_string(): pa.string(), pa.large_binary(): pa.binary()}.get(kind, kind)), ("term", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("df", pa.int64())])
        asked = texts["_several"].to_numpy() == several
        if not asked[part.row].any():
            return schema.empty_table()
        order, _ = part.dealt(word_buckets)
        answers = answers.sort_by("_bucket")
        of_words, of_pairs = (answers.filter(f(answers["ids"])) for f in (pc.is_valid, pc.is_null))
        found, row, at, n = in_rows(*part.terms(bigrams))
        base = len(part.words) + 1
        first, second = found // base, found % base - 1
        df = answered(of_words["df"], order)[first]
        if bigrams:
            pair = second >= 0
            df[pair] = answered(of_pairs["df"], Pairs.of(found[pair], answered(of_words["ids"], order), buckets).order)
        total = np.bincount(part.row, minlength=len(texts))
        total = total + np.maximum(total - 1, 0) if bigrams else total
        here = asked[row]
        row, at, n = row[here], at[here], n[here]
        total = total[row]
        keys, doc = numbered(texts["_key" if "_key" in texts.column_names else "_doc"], nulls="encode")
        doc = doc[row]
        if len(keys) < len(texts):  # rows that share an id: their counts add up
            together = doc * len(found) + at
            by = np.argsort(together, kind="stable")
            starts = runs(together[by])
            n, by = np.add.reduceat(n[by], starts), by[starts]
            row, at, total, doc = row[by], at[by], total[by], doc[by]
        names = pc.binary_join_element_wise(part.words.take(pa.array(first)), part.words.take(pa.array(second, mask=second < 0)), " ", null_handling="skip")
        if heaviest:
            kept = heaviest(doc, at, n, total, df[at], names)
            row, at, n, total = row[kept], at[kept], n[kept], total[kept]
        return pa.Table.from_batches(list(batches(texts, names, row, at, n, total, df[at], schema)), schema)

    return weigh


def batches(texts: pa.Table, names: pa.Array, row: np.ndarray, at: np.ndarray, n: np.ndarray, total: np.ndarray, df: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    docs = texts["_doc"].cast(schema.field("doc").type).combine_chunks()
    for lo in range(0, len(row), BATCH):
        span = slice(lo, lo + BATCH)
        yield pa.RecordBatch.from_arrays([docs.take(pa.array(row[span])), names.take(pa.array(at[span])), *[pa.array(x[span], pa.int64()) for x in (n, total, df)]], schema=schema)
