import random

import numpy as np
import pytest

from tests.llm.common import ODD, SCHEMA, empty, odd, some_docs
from tidemark.llm import graph, near


def shingles(text, k=5):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(s), (low.get(find(i), d) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def checked(spark, rows):
    got = near.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=key) == sorted(brute(rows), key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    return got


def test_odd_rows(spark):
    checked(spark, [r for r in ODD if "\x00" not in (r[1] or "")])
    assert near.near_duplicates(spark, odd(spark)).count() == len(ODD)
    assert near.near_duplicates(spark, empty(spark)).count() == 0


def test_chains_and_small_sets(spark):
    rng = random.Random(3)
    rows = []
    for g, n in enumerate((7, 12, 40, 150)):
        words = [f"w{g}x{i}" for i in range(n)]
        for _ in range(14):  # each copy differs a little from the one before: chains of links over texts that are not alike
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            words[rng.choice([0, n - 1, rng.randrange(n)])] += "y"
    rng.shuffle(rows)
    checked(spark, rows)


def test_large_groups(spark, duck):
    rng = random.Random(5)
    rows = [(i, t) for i, t in some_docs(duck, 60)]
    base = [f"b{i}" for i in range(90)]
    for i in range(250):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            words[rng.randrange(90)] = f"z{rng.randrange(9)}"
        rows.append((1000 + i, " ".join(words)))
    checked(spark, rows)


def test_texts_without_an_id_are_fetched_once(spark, monkeypatch):
    rows = [(i if i % 3 else None, " ".join(f"w{i // 2}x{j}" for j in range(40 - i % 2))) for i in range(60)]
    fetched, sets = [], near._sets
    monkeypatch.setattr(near, "_sets", lambda texts, k: fetched.append(texts.count()) or sets(texts, k))
    checked(spark, rows)
    assert fetched == [60]


def test_registers_estimate():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.85):
        pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        same = int(2000 * 2 * share / (1 + share) / 2 * 1)
        a, b = pool[:1000], np.concatenate([pool[: int(1000 * 2 * share / (1 + share))], pool[2000 : 2000 + 1000 - int(1000 * 2 * share / (1 + share))]])
        regs = near.registers(np.concatenate([a, b]), np.array([len(a), len(b)]))
        assert abs(near.estimate(regs[0], regs[1], len(a), len(b)) - share) < 0.16 and same > 0
    assert 0 < near.collisions(20, 20) < 0.01
    few = near.filled(near.registers(pool[:3], np.array([3])))
    assert (few != near.EMPTY).all()


def test_deduplicate(spark):
    docs = odd(spark)
    got = near.deduplicate(spark, docs)
    assert got.columns == docs.columns
    rows = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    # Rows without words link with nothing and stay; of repeated rows one stays.
    assert [r[0] for r in rows] == [-3, 1, 2, 3, 4, 5, 6, 7, 8, None]


@pytest.mark.parametrize("n", [1, 2, 30])
def test_components(spark, tmp_path, n):
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 105), (105, 103), (7000, 100)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(edges, str(tmp_path / "c")).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 105: 100, 103: 100, 7000: 100}
