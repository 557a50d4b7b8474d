import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.common import CLASHES
from tidemark.llm import queries, whitening


def brute(rows, components):
    """(id, component) -> (deviation, |whitened|, explained), with exact integers and a plain eigendecomposition."""
    d = max(len(x) for _, x in rows)
    full = np.array([list(x) + [0] * (d - len(x)) for _, x in rows], object)
    n, s = len(full), full.sum(axis=0)
    exact = n * full - s
    centred = (exact / n).astype(float)
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, (key, _) in enumerate(rows):
        for c in range(min(components, d)):
            some = e[c] > 1e-9 * e[0] and e[0] > 0
            out.append((key, c + 1, n, int((exact[i] ** 2).sum()), abs(float(centred[i] @ u[:, c]) / np.sqrt(e[c])) if some else 0.0, e[c] / np.trace(v) if some else 0.0))
    return out


def compare(found, want):
    key = lambda x: (str(x[0]), x[1], x[3], round(abs(x[4]), 6))
    found, want = sorted(found, key=key), sorted(want, key=key)
    assert [x[:4] for x in found] == [x[:4] for x in want]
    assert np.allclose([abs(x[4]) for x in found], [x[4] for x in want], atol=1e-7)
    assert np.allclose([x[5] for x in found], [x[5] for x in want], rtol=1e-6, atol=1e-12)


def got(spark, rows, components, schema="vec_id long, x array<bigint>"):
    df = spark.createDataFrame(rows, schema).repartition(3).withColumns({c: F.lit("extra") for c in [*CLASHES, "block", "index"]})
    return [(r["vec_id"], r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in whitening.whiten(spark, df, components=components).collect()]


@pytest.mark.parametrize("block", [1024, 16])
def test_against_plain_arithmetic(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK", block)
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(150, 6)) @ rng.normal(size=(6, 6)) * 40).astype(int) + 1000000
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(None, x[0].tolist()), (7, x[7].tolist()), (9, x[9].tolist()[:4])]
    found = got(spark, rows, 4)
    compare(found, brute(rows, 4))
    assert max(r[6] for r in found) < 1e-8
    assert len({r[6] for r in found}) == 1


def test_without_variance(spark):
    assert [r[3:6] for r in got(spark, [(1, [5, 6])], 2)] == [(0, 0.0, 0.0), (0, 0.0, 0.0)]
    flat = got(spark, [(i, [i, 3, 2 * i]) for i in range(10)], 3)
    assert all(r[4] == 0 and r[5] == 0 for r in flat if r[1] > 1) and abs(sum(r[5] for r in flat) - 10) < 1e-9 and max(r[6] for r in flat) < 1e-9


def test_nothing_to_do(spark):
    assert got(spark, [], 3) == [] and got(spark, [(1, []), (2, None)], 3) == []


def test_large_numbers(spark):
    rows = [(i, [10**9 * i + 1, 7 - 10**9 * i * i]) for i in range(20)]
    compare(got(spark, rows, 2), brute(rows, 2))


def test_finite(spark):
    rows = [(1, [1.0]), (2, None), (3, [None]), (4, [float("nan")]), (5, [float("-inf"), 1.0]), (6, [])]
    assert sorted(r[0] for r in spark.createDataFrame(rows, "vec_id long, v array<float>").where(whitening.finite("v")).collect()) == [1, 6]


def test_query(spark, duck):
    rows = [(i, [int(np.floor(64 * float(c))) + 1000000 for c in v]) for i, v in duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall()]
    found = [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in queries.op12_whitening(spark, SMALL).collect()]
    compare(found, brute(rows, 32))
    assert found[0][6] < 1e-8
