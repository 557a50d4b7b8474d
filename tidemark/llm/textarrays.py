"""Whole texts of an Arrow batch as one byte array: word borders, word hashes and run hashes without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text forms a slice of its own.
SLICE_BYTES = 2_000_000
ROOT = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD1342543DE82EF95)


def lookup(word_bytes, lower: bool = True) -> np.ndarray:
    """256 entries: 0 for a separator, else the byte (A-Z lower-cased)."""
    table = np.zeros(256, np.uint8)
    for b in word_bytes:
        table[b] = b + 32 if lower and 65 <= b <= 90 else b
    return table


#: Words between ASCII blanks. Byte 0 is a word byte there; 0x1F stands in for it, which keeps borders right and hashes apart enough for a later exact test.
BLANK_SEPARATED = lookup(b for b in range(256) if b != 32 and not 9 <= b <= 13)
BLANK_SEPARATED[0] = 31
#: Words of ASCII letters, digits and everything beyond ASCII.
ALPHANUMERIC = lookup(b for b in range(256) if b >= 0x80 or chr(b).isascii() and chr(b).isalnum())


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, borders): rows of the batch in slices of about `size` text bytes; null texts are empty."""
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    borders = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(borders, borders[row] + size, "right")) - 1)
        end = min(end, len(texts))
        yield row, end, raw[borders[row] : borders[end]], borders[row : end + 1] - borders[row]
        row = end


def words(data: np.ndarray, borders: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mapped bytes, starts, ends, words per text); a word never crosses a text's border."""
    mapped = table[data]
    inside = mapped != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = borders[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, borders))
    return mapped, starts, ends, counts


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def prefix(data: np.ndarray, base: int = int(ROOT)) -> np.ndarray:
    """Running sums of byte * base ** position."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = int(ROOT)) -> np.ndarray:
    """A hash of the bytes of each span, whatever its position."""
    back = powers(pow(base, -1, 1 << 64), len(sums))
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * STEP)


def word_hashes(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return spans_hash(prefix(mapped), starts, ends)


def runs(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words (all its words where they are fewer), and runs per text."""
    n = len(hashes)
    text = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    left = ends[text] - np.arange(n)  # words from here to the end of the text
    out = np.zeros(n, np.uint64)
    for j in range(k):
        part = np.zeros(n, np.uint64)
        part[: max(n - j, 0)] = hashes[j:]
        out = np.where(left > j, out * STEP + part + np.uint64(j + 1), out)
    first = np.zeros(n, bool)
    first[(ends - counts)[counts > 0]] = True
    whole = (left >= k) | first
    per = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    return mix(out[whole]), per
