import re
import zlib

import numpy as np
import pytest

from tests.llm.common import ODD, empty, odd
from tidemark.llm import langid, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").persist()


def test_fold(docs):
    rows = docs.select("doc_id", langid.in_fold("doc_id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_language_of_held_out_texts(spark, docs):
    net = langid.learn(docs)
    rows = langid.predict(docs.withColumn("held_out", langid.in_fold("doc_id")), net).where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    got = langid.predict(odd(spark), net)
    assert got.count() == len(ODD) and {"text_hash", "lang_pred", "score"} <= set(got.columns)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0) and found[4][0] != "und" and 0 < found[8][1] <= 1
    assert langid.predict(empty(spark), net).count() == 0
    assert langid.learn(empty(spark).withColumnRenamed("n", "lang")).languages == ["und"]


def test_windows_cover_whole_texts():
    raw = np.arange(700, dtype=np.int64).astype(np.uint8)
    windows, per = langid.windows_of(raw, np.array([0, 0, 100, 700]))
    assert per.tolist() == [1, 1, 3] and windows[0].sum() == 0 and windows[1][:100].tolist() == raw[:100].tolist()
    assert windows[-1].tolist() == raw[-256:].tolist()


def test_pair_tables_equal_plain_filters():
    net = langid.ByteNet.new(["a", "b"], seed=3)
    x = np.random.default_rng(0).integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    plain = np.concatenate([sum(k[j][x[:, j : langid.PLACES + j]] for j in range(w)).max(axis=1) for w, k in zip(langid.WIDTHS, net.kernels)], axis=1)
    assert np.allclose(net.pooled(x, net.tables()), plain, atol=1e-4)


def test_recurrent_gradients():
    """The step that training takes lowers the loss along the numerical gradient."""
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(9, toxicity.INPUTS)), np.zeros(toxicity.INPUTS)]).astype(np.float32)
    index, y = rng.integers(0, 10, (6, toxicity.WINDOW)), np.array([0, 1, 1, 0, 1, 0], np.float32)

    def loss(net):
        z = net.logits(x, index).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-z * (2 * y - 1)))))

    for name in ("wf", "ub", "a", "bf", "v", "c"):
        net = toxicity.GatedNet(1)
        net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
        before = {k: v.copy() for k, v in net.p.items()}
        net.train(x, index, y, steps=1, rate=1e-6, batch=6)
        step = {k: net.p[k] - before[k] for k in before}
        at = tuple(rng.integers(0, n) for n in before[name].shape)
        base = toxicity.GatedNet(1)
        base.p = {k: v.copy() for k, v in before.items()}
        base.p[name][at] += 1e-2
        high = loss(base)
        base.p[name][at] -= 2e-2
        slope = (high - loss(base)) / 2e-2
        assert abs(slope) < 1e-4 or np.sign(step[name][at]) == -np.sign(slope), name


def test_gradient_of_the_learned_inputs():
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(9, toxicity.INPUTS)), np.zeros(toxicity.INPUTS)])
    index, y = rng.integers(0, 9, (6, toxicity.WINDOW)), np.array([0, 1, 1, 0, 1, 0], np.float64)
    net = toxicity.GatedNet(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    got = np.zeros((10, toxicity.LEARNED))
    net.train(x, index, y, steps=1, rate=0.0, batch=6, learn=lambda places, gradient: np.add.at(got, places, gradient))
    for word, j in ((0, 0), (3, 2), (8, 3)):
        loss = []
        for step in (1e-3, -1e-3):
            moved = x.copy()
            moved[word, toxicity.COUNTED + j] += step
            z = net.logits(moved, index).astype(np.float64)
            loss.append(float(np.mean(np.log1p(np.exp(-z * (2 * y - 1))))))
        assert got[word, j] == pytest.approx((loss[0] - loss[1]) / 2e-3, abs=2e-4)


def plain_score(model, text):
    """Window by window, word by word: the forward pass as it is written in papers."""
    net, p = model.net, model.net.p
    words = [w.encode() for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))]
    if not words:
        return 0.0
    own = toxicity.Words(*toxicity.unique_words(*toxicity._joined([text])))
    rows = net.inputs(model.inputs.of(own), own)[own.index]
    assert len(rows) == len(words)
    size, sigmoid = toxicity.WINDOW, lambda v: 1 / (1 + np.exp(-v))
    starts = sorted({min(i, len(words) - size) for i in range(0, len(words) - size + toxicity.STRIDE, toxicity.STRIDE)}) if len(words) > size else [0]
    best = -np.inf
    for start in starts:
        x = rows[start : start + size].astype(np.float64)
        states = []
        for d, seen in (("f", x), ("b", x[::-1])):
            h, out = np.zeros(toxicity.HIDDEN), []
            if d == "b":  # places behind a short text come first; they are words of zeros
                seen = np.vstack([np.zeros((size - len(x), x.shape[1])), seen])
            for v in seen:
                z, r, c = np.split(v @ p["w" + d] + p["b" + d], 3)
                uz, ur, uc = np.split(p["u" + d], 3, axis=1)
                z, r = sigmoid(z + h @ uz), sigmoid(r + h @ ur)
                h = (1 - z) * h + z * np.tanh(c + (r * h) @ uc)
                out.append(h)
            states.append(out if d == "f" else out[::-1][: len(x)])
        s = np.hstack([np.array(states[0]), np.array(states[1])])
        weight = np.exp(s @ p["a"])
        best = max(best, float((weight / weight.sum()) @ s @ p["v"] + p["c"][0]))
    a, b = net.scale
    return float(sigmoid(a * best + b))


def test_scores_equal_the_plain_forward_pass(docs):
    rows = [(r["text"], r["doc_id"] % 3 == 0) for r in docs.where("text IS NOT NULL AND length(text) < 2000").orderBy("doc_id").limit(60).collect()]
    model = toxicity.fit([t for t, _ in rows], np.array([int(y) for _, y in rows]), steps=20)
    texts = [t for t, _ in rows[:25]] + ["", "one", "a b " * 16, "a b " * 16 + "c", " - "]
    assert np.allclose(model.scores(*toxicity._joined(texts)), [plain_score(model, t) for t in texts], atol=1e-4)


@pytest.mark.parametrize("d, least, found", [("sf0.01", 0.85, 0.5), ("sf0.1", 0.95, 0.85)])
def test_held_out_toxic_documents(spark, d, least, found):
    folder = f"/root/testdata/{d}"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.learn(docs, labels)
    held = docs.where(langid.in_fold("doc_id")).join(labels.where("toxic IS NOT NULL").select("doc_id", "toxic"), "doc_id").select("text", "toxic")
    rows = toxicity.score(held, model).select("toxic", "score").toPandas()
    high, low = rows.score[rows.toxic > 0].to_numpy(), rows.score[rows.toxic == 0].to_numpy()
    assert ((high[:, None] > low) + 0.5 * (high[:, None] == low)).mean() >= least
    assert (high >= 0.5).mean() >= found and (low >= 0.5).mean() <= 0.02


def test_words_of_slices_equal_words_of_all(docs, monkeypatch):
    texts = [r["text"] or "" for r in docs.where("length(text) < 3000").orderBy("doc_id").limit(80).collect()] + ["", " ", "x"]
    whole = toxicity.Words(*toxicity.unique_words(*toxicity._joined(texts)))
    for size in (2_000_000, 5_000, 2):
        monkeypatch.setattr(toxicity, "SLICE_BYTES", size)
        parts = toxicity.Words.of(texts)
        assert all((getattr(whole, c) == getattr(parts, c)).all() for c in ("hashes", "index", "counts", "first"))
        assert all(sorted(whole.grams[a:b]) == sorted(parts.grams[a:b]) for a, b in zip(whole.first, np.append(whole.first[1:], len(whole.grams))))
    assert len(toxicity.Words.of([]).hashes) == 0


def test_calibration_keeps_the_order():
    a, b = toxicity.calibration(np.array([3.0, 2.0, -1.0, -2.0, 0.5]), np.array([0.0, 0, 1, 1, 0]))
    assert 0 < a <= 1
    a, b = toxicity.calibration(np.array([-2.0, -1.0, 4.0, 5.0] * 20), np.array([0.0, 0, 1, 1] * 20))
    assert 1 / (1 + np.exp(-(a * 4 + b))) > 0.9 > 0.1 > 1 / (1 + np.exp(-(b - a)))


def test_toxicity_of_held_out_texts():
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(400)]
    insults = ["stinkor", "vexulo", "vexuma", "vexuri", "vexuna"]

    def text(toxic, long=False):
        words = list(rng.choice(vocabulary, 400 if long else rng.integers(1, 90)))
        if toxic:
            for _ in range(3):
                words.insert(rng.integers(0, len(words) + 1), rng.choice(insults))
        return " ".join(words)

    y = (np.arange(900) % 3 == 0).astype(int)
    model = toxicity.fit([text(t) for t in y], y)
    held = [text(t, long) for t in (0, 1) for long in (False, True) for _ in range(60)]
    score = model.scores(*toxicity._joined(held))
    assert np.mean((score >= 0.5) == (np.arange(240) >= 120)) > 0.97
    # A new insult of a known stem is known by its characters.
    assert model.scores(*toxicity._joined(["abc def vexuqq vexuzz fed"]))[0] > model.scores(*toxicity._joined(["abc def gahb fed"]))[0]


def test_windows_overlap_and_reach_the_end():
    at, per = toxicity.frames(np.array([0, 5, 32, 33, 100]))
    assert per.tolist() == [0, 1, 1, 2, 6] and set(at[at >= 0].tolist()) == set(range(170))
    assert (at[0] >= 0).sum() == 5 and at[-1][-1] == 169


def test_toxicity_rows(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.learn(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(odd(spark), model).collect()}
    assert len(got) == len({i for i, _ in ODD}) and all(0 <= s <= 1 for s in got.values()) and got[1] == got[2] == got[3] == 0
    assert toxicity.score(empty(spark), model).count() == 0
    nothing = toxicity.learn(docs, labels.limit(0))
    assert all(r["score"] < 0.5 for r in toxicity.score(docs.limit(5), nothing).collect())
