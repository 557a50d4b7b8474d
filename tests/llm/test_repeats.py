import hashlib
import random

import pytest

from tests.conftest import SMALL
from tests.llm.common import ODD, SCHEMA, empty, odd, some_docs
from tidemark.llm import repeats
from tidemark.llm.queries import op4_repeats


def brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    places = {}
    for d, b in enumerate(raw):
        for i in range(len(b) - length + 1):
            places.setdefault(b[i : i + length], []).append((d, i))
    gone = [bytearray(len(b)) for b in raw]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                gone[d][i : i + length] = b"\1" * length
    out = []
    for (i, _), b, g in zip(rows, raw, gone):
        spans, at = [], 0
        while (s := g.find(1, at)) >= 0:
            e = g.find(0, s)
            at = len(g) if e < 0 else e
            spans.append((s, at))
        out.append((i, len(b), spans, bytes(x for x, y in zip(b, g) if not y)))
    return sorted(out, key=str)


def got(spark, rows, length, **options):
    found = repeats.repeated_spans(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), length, **options).collect()
    return sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in found), key=str)


@pytest.mark.parametrize("merge_rows", [repeats.MERGE_ROWS, 1])
def test_planted_repeats(spark, duck, merge_rows):
    rng = random.Random(9)
    texts = [t for _, t in some_docs(duck, 50)]
    rows = ODD[:11] + [(100 + i, t) for i, t in enumerate(texts)]
    passage = texts[3][:700]
    for i in range(25):  # a passage between changing neighbours, cut at both ends
        a, b = rng.randrange(0, 200), rng.randrange(450, 700)
        rows.append((300 + i, f"{i} start " + passage[a:b] + f" end {i * i}"))
    rows.append((400, texts[5] + " and again " + texts[5]))
    rows.append((401, "ab" * 600))
    rows.append((402, "x" * 399))
    for i in range(12):  # near copies
        words = texts[8].split(" ")
        words[rng.randrange(len(words))] = "CHANGED"
        rows.append((500 + i, " ".join(words)))
    assert got(spark, rows, 400, merge_rows=merge_rows) == brute(rows, 400)


def test_passages_of_over_fifty_words(spark, duck):
    """Passages of 50 to 120 words, on both sides of 400 bytes, planted in texts of their own: exactly the bytes that brute force removes."""
    rng = random.Random(3)
    words = max((t for _, t in some_docs(duck, 80)), key=len).split()
    rows, planted = [], []
    for i, n in enumerate(range(50, 121, 5)):
        at = rng.randrange(0, len(words) - n)
        part = " ".join(words[at : at + n])
        planted.append(len(part.encode()))
        for j in range(2 + i % 3):
            rows.append((1000 * i + j, " ".join(f"a{i}x{j}y{k}" for k in range(30)) + "\n" + part + "\n" + " ".join(f"b{i}x{j}y{k}" for k in range(30))))
    assert min(planted) < 400 < max(planted)
    found = got(spark, rows, 400)
    assert found == brute(rows, 400)
    assert all(bool(r[2]) == (planted[r[0] // 1000] >= 398) for r in found if abs(planted[r[0] // 1000] - 400) > 2)


@pytest.mark.parametrize("length", [100, 137])
def test_other_lengths(spark, duck, length):
    rows = [(i, t[:3000]) for i, t in some_docs(duck, 60)]
    assert got(spark, rows, length) == brute(rows, length)


def test_rows(spark):
    assert repeats.repeated_spans(spark, odd(spark)).count() == len(ODD)
    assert repeats.repeated_spans(spark, empty(spark)).count() == 0


def test_every_column_of_the_query(spark, duck):
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    want = [(i, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), len(kept), bool(spans)) for i, n, spans, kept in brute(rows, 400)]
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "repeats"]
    assert sorted(tuple(r) for r in op4_repeats(spark, SMALL).select(columns).collect()) == sorted(want)
    assert 0 < sum(r[-1] for r in want) < len(want)
