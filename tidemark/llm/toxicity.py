"""Toxicity of whole texts: a bidirectional gated recurrent network with attention over word and character inputs, trained with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.langid import in_fold
from tidemark.llm.textarrays import ALPHANUMERIC, SLICE_BYTES, mix, prefix, slices, spans_hash, words

#: Words in a window, words from one window to the next, state size of each direction, counted and learned inputs of a word.
WINDOW, STRIDE, HIDDEN, COUNTED, LEARNED = 32, 16, 8, 4, 4
INPUTS = COUNTED + LEARNED
GRAMS = 1 << 16
BATCH = 4096


def _tanh(x: np.ndarray) -> np.ndarray:
    return np.tanh(x, out=x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def unique_words(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of distinct words, index of each word in them, words per text, buckets of the distinct words' character n-grams, first bucket of each)."""
    mapped, starts, ends, counts = words(data, borders, ALPHANUMERIC)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), counts, np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = prefix(mapped)
    hashes, first, index = np.unique(spans_hash(sums, starts, ends), return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    grams, owners = [], []
    for k in (3, 4, 5):  # every k bytes of a word, those at its start marked, and the whole word if it is shorter
        many = np.maximum(e - s - k + 1, 1)
        owner = np.repeat(np.arange(len(s)), many)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        a = s[owner] + inside
        h = spans_hash(sums, a, np.minimum(a + k, e[owner])) + (inside == 0).astype(np.uint64) * np.uint64(77)
        grams.append((mix(h + np.uint64(k)) % np.uint64(GRAMS)).astype(np.int64))
        owners.append(owner)
    owner, gram = np.concatenate(owners), np.concatenate(grams)
    order = np.argsort(owner, kind="stable")
    return hashes, index.ravel(), counts, gram[order], np.searchsorted(owner[order], np.arange(len(s)))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def frames(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word places, -1 where there is none; windows per text): all overlapping windows; the last one ends with the text; none for a text without words."""
    per = np.where(counts > WINDOW, -(-(counts - WINDOW) // STRIDE) + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), per)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    start = np.maximum(np.minimum(number * STRIDE, counts[text] - WINDOW), 0)
    place = start[:, None] + np.arange(WINDOW)
    return np.where(place < counts[text][:, None], (np.cumsum(counts) - counts)[text][:, None] + place, -1), per


@dataclass
class Words:
    """The words of some texts: see unique_words()."""

    hashes: np.ndarray
    index: np.ndarray
    counts: np.ndarray
    grams: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        """The words of any number of texts, found SLICE_BYTES at a time, so memory follows the words and not the bytes."""
        parts, a = [], 0
        sizes = np.cumsum([len(t) for t in texts])
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + SLICE_BYTES // 2, "right")))
            parts.append(cls(*unique_words(*_joined(texts[a:b]))))
            a = b
        hashes = distinct(np.concatenate([np.zeros(0, np.uint64), *(p.hashes for p in parts)]))
        known = np.zeros(len(hashes), bool)
        index, names, many, grams = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for p in parts:
            name = np.searchsorted(hashes, p.hashes)
            index.append(name[p.index].astype(np.int32))
            new = ~known[name]
            known[name] = True
            own = p.many[new]
            names.append(name[new])
            many.append(own)
            grams.append(p.grams[np.repeat(p.first[new] - (np.cumsum(own) - own), own) + np.arange(own.sum())])
        name, own, gram = np.concatenate(names), np.concatenate(many), np.concatenate(grams)
        order = np.argsort(name)
        begin, own = (np.cumsum(own) - own)[order], own[order]
        first = np.cumsum(own) - own
        return cls(hashes, np.concatenate(index), np.concatenate([np.zeros(0, np.int64), *(p.counts for p in parts)]), gram[np.repeat(begin - first, own) + np.arange(own.sum())], first)

    @property
    def many(self) -> np.ndarray:
        """Character n-grams of each distinct word."""
        return np.diff(np.append(self.first, len(self.grams)))


@dataclass
class Inputs:
    """What training rows say about a word: how much oftener toxic texts have it, and have its character n-grams."""

    known: np.ndarray  # sorted hashes
    odds: np.ndarray
    gram_odds: np.ndarray

    @classmethod
    def weigh(cls, hashes: np.ndarray, words_seen: np.ndarray, grams_seen: np.ndarray, n: np.ndarray, least: int = 3) -> Inputs:
        """From the number of clean and toxic texts (rows 0 and 1), and of those that have each word and each bucket of n-grams."""
        n = np.maximum(n, 1)
        often = words_seen.sum(axis=0) >= least
        odds = np.log((words_seen[1] + 0.5) / (n[1] + 1)) - np.log((words_seen[0] + 0.5) / (n[0] + 1))
        gram_odds = np.log((grams_seen[1] + 1) / (n[1] + 2)) - np.log((grams_seen[0] + 1) / (n[0] + 2))
        gram_odds[grams_seen.sum(axis=0) < least] = 0
        return cls(hashes[often], np.clip(odds[often], -3, 5).astype(np.float32), np.clip(gram_odds, -3, 5).astype(np.float32))

    def of(self, w: Words) -> np.ndarray:
        """COUNTED numbers for each distinct word, and a last row of zeros for no word."""
        out = np.zeros((len(w.hashes) + 1, COUNTED), np.float32)
        if len(w.hashes) and len(self.known):
            at = np.minimum(np.searchsorted(self.known, w.hashes), len(self.known) - 1)
            hit = self.known[at] == w.hashes
            out[:-1, 0] = np.where(hit, self.odds[at], 0)
            out[:-1, 1] = hit
        if len(w.hashes):
            g = self.gram_odds[w.grams]
            out[:-1, 2] = np.maximum.reduceat(g, w.first)
            out[:-1, 3] = np.add.reduceat(g, w.first) / w.many
        return out


def tally(w: Words, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(groups x words, groups x GRAMS): how many texts of each group have each word, and each bucket of n-grams; some texts at a time."""
    words_seen, grams_seen = np.zeros((groups, len(w.hashes)), np.int32), np.zeros((groups, GRAMS), np.int32)
    ends, size, many = np.cumsum(w.counts), len(w.hashes), w.many
    a = 0
    while a < len(group):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + 50_000, "right")))
        part = w.index[ends[a] - w.counts[a] : ends[min(b, len(group)) - 1]]
        text = np.repeat(np.arange(a, min(b, len(group))), w.counts[a:b])
        text, word = np.divmod(distinct(text * np.int64(size + 1) + part), size + 1)
        np.add.at(words_seen, (group[text], word), 1)
        at = np.repeat(w.first[word] - (np.cumsum(many[word]) - many[word]), many[word]) + np.arange(many[word].sum())
        text, gram = np.divmod(distinct(np.repeat(text, many[word]) * np.int64(GRAMS) + w.grams[at]), GRAMS)
        np.add.at(grams_seen, (group[text], gram), 1)
        a = b
    return words_seen, grams_seen


class GatedNet:
    """Both directions share one shape: update and reset gates and candidate from input and state, then attention over places and a logistic output."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        init = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        #: Learned vectors of character n-grams; those of a word's n-grams are averaged.
        self.grams = np.zeros((GRAMS, LEARNED), np.float32)
        self.p = {"wf": init(INPUTS, 3 * HIDDEN), "wb": init(INPUTS, 3 * HIDDEN), "uf": init(HIDDEN, 3 * HIDDEN), "ub": init(HIDDEN, 3 * HIDDEN), "bf": np.zeros(3 * HIDDEN, np.float32),
                  "bb": np.zeros(3 * HIDDEN, np.float32), "a": init(2 * HIDDEN), "v": init(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        self.scale = (1.0, 0.0)

    def inputs(self, counted: np.ndarray, w: Words) -> np.ndarray:
        """INPUTS numbers for each distinct word: the counted ones, and the mean of its n-grams' learned vectors."""
        out = np.zeros((len(counted), INPUTS), np.float32)
        out[:, :COUNTED] = counted
        if len(w.hashes):
            out[: len(w.hashes), COUNTED:] = np.add.reduceat(self.grams[w.grams], w.first) / w.many[:, None]
        return out

    def _run(self, x: np.ndarray, index: np.ndarray, d: str, keep: bool):
        """States (places, windows, HIDDEN) of one direction; x holds each distinct word's projected input."""
        u, n = self.p["u" + d], len(index)
        h = np.zeros((n, HIDDEN), np.float32)
        states, trace = np.empty((WINDOW, n, HIDDEN), np.float32), []
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            own = x[index[:, t]]
            g = _sigmoid(own[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
            z, r = g[:, :HIDDEN], g[:, HIDDEN:]
            rh = r * h
            c = _tanh(own[:, 2 * HIDDEN :] + rh @ u[:, 2 * HIDDEN :])
            new = h + z * (c - h)
            if keep:
                trace.append((t, h, z, r, rh, c))
            states[t] = h = new
        return states, trace

    def logits(self, x: np.ndarray, index: np.ndarray, keep: bool = False):
        """x: inputs of distinct words, the last row for none; index: (windows, WINDOW) into x."""
        xf, xb = x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]
        (sf, tf), (sb, tb) = self._run(xf, index, "f", keep), self._run(xb, index, "b", keep)
        s = np.concatenate([sf, sb], axis=2)
        e = s @ self.p["a"]
        e[index.T == len(x) - 1] = -30
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", e, s)
        out = pooled @ self.p["v"] + self.p["c"][0]
        return (out, s, e, pooled, tf, tb) if keep else out

    def heights(self, x: np.ndarray, index: np.ndarray) -> np.ndarray:
        """logits() for any number of windows; each batch only projects its own words."""
        out = [np.zeros(0, np.float32)]
        for i in range(0, len(index), BATCH):
            own = distinct(np.append(index[i : i + BATCH].ravel(), len(x) - 1))
            out.append(self.logits(x[own], np.searchsorted(own, index[i : i + BATCH])))
        return np.concatenate(out)

    def train(self, x: np.ndarray, index: np.ndarray, y: np.ndarray, steps: int, rate: float = 0.01, batch: int = 64, seed: int = 0, learn=None) -> None:
        """Steps of Adam on batches of windows. `learn(words, gradient)` gets the gradient of the learned inputs of the batch's places."""
        rng, p = np.random.default_rng(seed), self.p
        m, v = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}
        order = np.zeros(0, np.int64)
        for step in range(1, steps + 1):
            if len(order) < min(batch, len(index)):
                order = np.append(order, rng.permutation(len(index)))
            at, order = order[:batch], order[batch:]
            # Only the batch's own words are projected; the row for no word stays the last one.
            own = distinct(np.append(index[at].ravel(), len(x) - 1))
            idx, rows = np.searchsorted(own, index[at]), x[own]
            out, s, e, pooled, tf, tb = self.logits(rows, idx, True)
            d = (1 / (1 + np.exp(-out)) - y[at]) / len(at)
            g = {"v": pooled.T @ d, "c": np.array([d.sum()], np.float32)}
            dp = d[:, None] * p["v"]
            ds = e[:, :, None] * dp
            de = np.einsum("tnh,nh->tn", s, dp)
            de = e * (de - (e * de).sum(axis=0))
            g["a"] = np.einsum("tn,tnh->h", de, s)
            ds += de[:, :, None] * p["a"]
            dx = np.zeros((WINDOW, len(at), LEARNED), np.float32)
            for k, trace, part in (("f", tf, ds[:, :, :HIDDEN]), ("b", tb, ds[:, :, HIDDEN:])):
                u = p["u" + k]
                gu, gw, gb = np.zeros_like(u), np.zeros_like(p["w" + k]), np.zeros_like(p["b" + k])
                dh = np.zeros((len(at), HIDDEN), np.float32)
                for t, h, z, r, rh, c in reversed(trace):
                    dh = dh + part[t]
                    dc = dh * z * (1 - c * c)
                    dz = dh * (c - h) * z * (1 - z)
                    drh = dc @ u[:, 2 * HIDDEN :].T
                    dr = drh * h * r * (1 - r)
                    dg = np.concatenate([dz, dr, dc], axis=1)
                    gu[:, : 2 * HIDDEN] += h.T @ dg[:, : 2 * HIDDEN]
                    gu[:, 2 * HIDDEN :] += rh.T @ dc
                    gw += rows[idx[:, t]].T @ dg
                    gb += dg.sum(axis=0)
                    dx[t] += dg @ p["w" + k][COUNTED:].T
                    dh = dh * (1 - z) + drh * r + dg[:, : 2 * HIDDEN] @ u[:, : 2 * HIDDEN].T
                g |= {"u" + k: gu, "w" + k: gw, "b" + k: gb}
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] * g[k]
                p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
            if learn is not None:
                learn(own[idx].T.ravel(), dx.reshape(-1, LEARNED))


@dataclass
class Model:
    inputs: Inputs
    net: GatedNet

    def raw(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """The highest window of each text, before calibration; NaN for a text without words."""
        w = Words(*unique_words(data, borders))
        x = self.net.inputs(self.inputs.of(w), w)
        at, per = frames(w.counts)
        out = np.full(len(w.counts), np.nan)
        if not len(at):
            return out
        index = np.append(w.index, len(w.hashes))[at]
        logits = np.concatenate([self.net.logits(x, index[i : i + BATCH]) for i in range(0, len(index), BATCH)])
        out[per > 0] = np.maximum.reduceat(logits, (np.cumsum(per) - per)[per > 0])
        return out

    def scores(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        a, b = self.net.scale
        return np.nan_to_num(1 / (1 + np.exp(-np.clip(a * self.raw(data, borders) + b, -30, 30))), nan=0.0)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)


def calibration(height: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit, by Newton's method with a weak pull towards the slope 1; the slope stays positive, because a higher window is never less toxic."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * height + b, -30, 30)))
        q = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - label) * height).sum() + 0.1 * (a - 1), (p - label).sum() + 0.01 * b])
        h = np.array([[(q * height * height).sum() + 0.1, (q * height).sum()], [(q * height).sum(), q.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = max(a - step[0], 0.05), b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of values summed by owner."""
    return np.stack([np.bincount(owner, weights=column, minlength=n) for column in values.T], axis=1).astype(np.float32)


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 3, steps: int = 200, folds: int = 4, seed: int = 0) -> Model:
    """Counted inputs of a text come from the other folds of the texts, so that they are as uncertain as those of new texts; at scoring they come from all texts.

    A text's label belongs to its highest window: each round trains on that window of every text (at first the one with the strongest inputs) and on
    windows of clean texts at random, for `steps` steps however few texts there are, then finds the highest ones anew. The learned vectors of character n-grams are trained along.
    A logistic fit of the highest windows calibrates the scores. With texts of one label only, all scores are near that label.
    """
    toxic = np.asarray(toxic)
    w = Words.of(texts)
    fold, size = np.arange(len(texts)) % folds, len(w.hashes)
    words_seen, grams_seen = (t.reshape(folds, 2, -1) for t in tally(w, fold * 2 + (toxic > 0), folds * 2))
    n = np.bincount(fold * 2 + (toxic > 0), minlength=folds * 2).reshape(folds, 2)
    model = Model(Inputs.weigh(w.hashes, words_seen.sum(axis=0), grams_seen.sum(axis=0), n.sum(axis=0)), GatedNet(seed))
    net, y = model.net, toxic.astype(np.float32)
    at, per = frames(w.counts)
    if not len(at) or len(np.unique(y[per > 0])) < 2:
        net.scale = (0.0, -30.0 if not len(y) or y.mean() < 0.5 else 30.0)
        return model
    # Each fold has inputs of its own for every distinct word: block g of the rows; the last row is no word.
    x = np.zeros((folds * size + 1, INPUTS), np.float32)
    for g in range(folds):
        rest = np.arange(folds) != g
        x[g * size : (g + 1) * size, :COUNTED] = Inputs.weigh(w.hashes, words_seen[rest].sum(axis=0), grams_seen[rest].sum(axis=0), n[rest].sum(axis=0)).of(w)[:-1]
    owner = np.repeat(np.arange(len(per)), per)
    windows = np.where(at >= 0, w.index[at] + fold[owner][:, None] * size, folds * size).astype(np.int32)
    squares = np.full((GRAMS, 1), 1e-3, np.float32)

    def learn(place: np.ndarray, gradient: np.ndarray) -> None:
        """A step on the vectors of the n-grams of these words (Adagrad); x follows once a round."""
        there = place < folds * size
        word, own = np.unique(place[there] % size, return_inverse=True)
        total = _sums(own.ravel(), gradient[there], len(word))
        many = w.many[word]
        gram = w.grams[np.repeat(w.first[word] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        gram, own = np.unique(gram, return_inverse=True)
        g = _sums(own.ravel(), np.repeat(total / many[:, None], many, axis=0), len(gram))
        squares[gram] += (g * g).mean(axis=1, keepdims=True)
        net.grams[gram] -= 0.01 * (g / np.sqrt(squares[gram]) + 0.01 * net.grams[gram])

    begins = (np.cumsum(per) - per)[per > 0]
    height = (x[:, 0] + x[:, 2])[windows].max(axis=1)
    rng = np.random.default_rng(seed)
    for r in range(rounds):
        best = np.lexsort((-height, owner))[begins]
        clean = np.flatnonzero(y[owner] == 0)
        chosen = np.append(best, rng.choice(clean, min(len(clean), 2 * len(best)), replace=False)) if len(clean) else best
        net.train(x, windows[chosen], y[owner[chosen]], steps=max(steps, len(chosen) // 64), seed=seed + r, learn=learn)
        learned = net.inputs(np.zeros((size + 1, COUNTED), np.float32), w)[:-1, COUNTED:]
        for g in range(folds):
            x[g * size : (g + 1) * size, COUNTED:] = learned
        height = net.heights(x, windows)
    net.scale = calibration(np.maximum.reduceat(height, begins), y[per > 0])
    return model


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 3000, longest: int = 20_000, seed: int = 0) -> Model:
    """A model fitted on a bounded sample of the labelled rows that aren't held out: about `per_class` documents of either label, chosen by a hash of their
    ids, of at most `longest` characters. Their ids go into the filter of the scan, so only sampled texts are shuffled; of several texts with one id the first in order teaches. Null ids, texts and labels teach nothing; an id
    with several labels counts as toxic if one of them says so."""
    marked = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~in_fold("doc_id"))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    place = F.xxhash64("doc_id", F.lit("toxic")).bitwiseAND((1 << 53) - 1) / float(1 << 53)
    share = F.when(F.col("toxic") > 0, min(1.0, per_class / max(1, counts.get(1, 0)))).otherwise(min(1.0, per_class / max(1, counts.get(0, 0))))
    chosen: dict = {}
    for r in marked.where(place < share).orderBy(place, "doc_id", "toxic").limit(4 * per_class).collect():
        chosen[r["doc_id"]] = max(chosen.get(r["doc_id"], 0), int(r["toxic"] > 0))
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isin(list(chosen)) & (F.length("text") <= longest))
    # One text for each id, so the sample is bounded by its ids; ordered by a hash, which deals both labels out over the folds.
    one = picked.groupBy("doc_id").agg(F.min("text").alias("text")).withColumn("order", F.xxhash64("doc_id", F.lit("order")))
    rows = [(r["doc_id"], r["text"]) for r in sorted(one.collect(), key=lambda r: (r["order"], r["doc_id"]))]
    return fit([t for _, t in rows], np.array([chosen[i] for i, _ in rows], np.int64), seed=seed)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with score (0 to 1): the highest of all overlapping windows of the whole text; 0 for null texts and texts without words.

    Every other column is kept; one that is already named score is replaced.
    """
    kept = docs.drop("score")
    schema = T.StructType(kept.schema.fields + [T.StructField("score", T.DoubleType())])

    def rows(batches):
        for batch in batches:
            out = [model.scores(data, borders) for _, _, data, borders in slices(batch, text)]
            values = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, "score"])

    return kept.mapInArrow(rows, schema)
