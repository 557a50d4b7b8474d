import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.common import CLASHES
from tidemark.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, asks, positives=5, negatives=10, low=30, high=90, scale=256):
    taken = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        taken.append((i, [int(np.floor(scale * float(np.float32(x)))) for x in v], label))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for n, (i, v, label) in enumerate(taken):
        if i is None or not asks(i):
            continue
        dots = [(sum(a * b for a, b in zip(v, w)), j, k) for m, (j, w, k) in enumerate(taken) if m != n]
        for p, pid, _ in sorted((x for x in dots if x[2] == label), key=order)[:positives]:
            band = sorted((x for x in dots if x[2] != label and low * p <= 100 * x[0] <= high * p), key=order)[:negatives]
            out += [(i, pid, r, nid, p, s) for r, (s, nid, _) in enumerate(band, 1)]
    return sorted(out, key=str)


def got(spark, rows, condition, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("extra") for c in CLASHES if c != "vec_id"})
    return sorted((tuple(r) for r in hardneg.hard_negatives(spark, df, condition, **options).collect()), key=str)


def some_rows(n=300, d=20, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(4, d))
    labels = rng.integers(0, 4, n)
    vectors = (centers[labels] + rng.normal(size=(n, d))).astype("float32")
    return [(int(i), [float(x) for x in v], int(k)) for i, (v, k) in enumerate(zip(vectors, labels))]


ODD = [
    (None, [0.5] * 20, 1), (None, [0.5] * 20, 1), (1000, None, 1), (1010, [None] + [0.1] * 19, 1), (1020, [float("nan")] * 20, 2), (1030, [float("inf")] + [0.0] * 19, 2), (1040, [0.3] * 20, None),
    (1050, [], 1), (1060, [0.25] * 3, 2), (1070, [-0.001] * 20, 3), (1080, [1000.0] * 20, 3), (1090, [0.0] * 20, 0), (10, [1.0] * 20, 1), (10, [1.0] * 20, 1), (10, [1.0] * 20, 2), (20, [1.5] * 25, 1),
]


@pytest.mark.parametrize("block, least", [(1024, 8), (7, 3)])
def test_against_brute_force(spark, monkeypatch, block, least):
    monkeypatch.setattr(hardneg, "ANCHORS", block)
    monkeypatch.setattr(hardneg, "LEAST_SLICES", least)
    rows = some_rows() + ODD
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 500
    assert got(spark, rows, F.col("vec_id") % 10 == 0) == want


def test_repeated_rows_and_ties(spark):
    rows = [r for r in some_rows(40, 8) for _ in range(3)] + [(i, [1.0] * 8, i % 2) for i in range(100, 160)]
    assert got(spark, rows, F.col("vec_id") % 5 == 0, positives=4, negatives=7, low=10, high=100) == brute(rows, lambda i: i % 5 == 0, 4, 7, 10, 100)


def test_nothing_to_do(spark):
    assert got(spark, [], F.col("vec_id") % 10 == 0) == []
    assert got(spark, some_rows(20), F.lit(False)) == []
    assert got(spark, [(0, [1.0] * 8, 1), (1, [1.0] * 8, 2)], F.col("vec_id") == 0) == []


def test_tables_give_exact_products():
    rng = np.random.default_rng(1)
    for most in (1, 2, 300, 1 << 28):
        x, y = rng.integers(-most, most, (9, 24)), rng.integers(-most, most, (50, 24))
        import pyarrow as pa

        codes = [hardneg.encode(pa.array(m.astype("float64").tolist(), pa.list_(pa.float64())), 1) for m in (x, y)]
        assert (hardneg.decode(codes[1]) == y).all()
        assert (hardneg.scores(hardneg.subset_sums(hardneg.decode(codes[0])), codes[1]) == x @ y.T).all()


def test_a_component_beyond_a_long_is_an_error(spark):
    with pytest.raises(Exception, match="does not fit"):
        got(spark, [(0, [1e30] * 8, 1)], F.col("vec_id") == 0)
