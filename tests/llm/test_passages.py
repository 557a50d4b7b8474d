import hashlib
import random

import pytest

from tests.llm.common import ODD, SCHEMA, empty, odd, some_docs
from tidemark.llm import passages, queries

BLANKS = " \t\n\v\f\r"


def split(text):
    out, word = [], ""
    for c in text or "":
        if c in BLANKS:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def brute(rows, length):
    """Every window against the smallest id it starts in."""
    rank = lambda i: passages.LAST if i is None else i
    texts = [(i, split(t)) for i, t in rows]
    first = {}
    for i, w in texts:
        for j in range(len(w) - length + 1):
            key = tuple(w[j : j + length])
            first[key] = min(first.get(key, passages.LAST), rank(i))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for j in range(len(w) - length + 1):
            if first[tuple(w[j : j + length])] < rank(i):
                gone[j : j + length] = [True] * length
        spans = []
        for j, g in enumerate(gone):
            if g and spans and spans[-1][1] == j:
                spans[-1] = (spans[-1][0], j + 1)
            elif g:
                spans.append((j, j + 1))
        out.append((i, len(w), spans, " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def got(spark, rows, length):
    found = passages.repeated_passages(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), length).collect()
    return sorted(((r["doc_id"], r["n_words"], [(s["start"], s["end"]) for s in r["spans"]], r["kept"]) for r in found), key=str)


def planted(duck):
    rng = random.Random(4)
    texts = [t for _, t in some_docs(duck, 50)]
    rows = ODD[:11] + [(100 + i, t) for i, t in enumerate(texts)]
    passage = max(texts, key=len).split()[:130]
    for i in range(30):  # passages of 45 to 120 words between changing neighbours and blanks
        a = rng.randrange(0, 10)
        part = passage[a : a + rng.randrange(45, 121)]
        rows.append((300 - i, f"{i} start\n" + rng.choice([" ", "  ", "\t"]).join(part) + f" end {i * i}"))
    rows += [(400, texts[5] + " and again " + texts[5]), (401, "ab " * 200), (402, "ab " * 120), (None, texts[7]), (None, texts[7]), (None, "q " + texts[7])]
    for i in range(12):  # near copies
        w = texts[8].split(" ")
        w[rng.randrange(len(w))] = "CHANGED"
        rows.append((500 + i, " ".join(w)))
    rows += [(600, "x\x00y " * 60), (601, "x\x1fy " * 60), (602, "X\x00Y " * 60), (603, "a b " * 49 + "c"), (604, "a b " * 49 + "C")]
    return rows


@pytest.mark.parametrize("length", [50, 13, 1])
def test_every_window(spark, duck, length):
    rows = planted(duck)
    assert got(spark, rows, length) == brute(rows, length)


def test_first_copy_stays(spark, duck):
    words = max((t for _, t in some_docs(duck, 50)), key=len).split()[:60]
    rows = [(i, f"w{i} " + " ".join(words) + f" v{i}") for i in (5, 3, 9)]
    found = {i: spans for i, _, spans, _ in got(spark, rows, 50)}
    assert found == {3: [], 5: [(1, 61)], 9: [(1, 61)]}


def test_odd_tables(spark):
    assert passages.repeated_passages(spark, odd(spark)).count() == len(ODD)
    assert passages.repeated_passages(spark, empty(spark)).count() == 0


def test_many_rows_without_an_id(spark):
    body = " ".join(f"word{i}" for i in range(200))
    docs = spark.range(4000).selectExpr("CASE WHEN id = 0 THEN 1L END AS doc_id", f"'{body}' AS text").repartition(4)
    found = passages.repeated_passages(spark, docs).groupBy("doc_id", "kept").count().collect()
    assert sorted((r["doc_id"] or 0, len(r["kept"]), r["count"]) for r in found) == [(0, 0, 3999), (1, len(body), 1)]


def test_query(spark, duck):
    d = "/root/testdata/sf0.001"
    want = sorted((i, n, sum(e - s for s, e in spans), hashlib.sha256(k.encode()).hexdigest()) for i, n, spans, k in brute(duck.sql("SELECT doc_id, text FROM documents").fetchall(), 50))
    found = queries.op13_passages(spark, d).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(tuple(r) for r in found) == want
