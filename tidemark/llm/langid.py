"""Language of whole texts by a byte convolutional network: filters of three widths, max pooling and softmax, trained with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.textarrays import slices

#: Bytes per window, filter widths, filters of each width. A window's tail that no widest filter fits into is left to the shorter step before it.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
PLACES = WINDOW - max(WIDTHS) + 1
#: Windows scored at once.
BATCH = 512


@dataclass
class ByteNet:
    languages: list[str]
    kernels: list[np.ndarray]  # per width: (width, 256, FILTERS)
    bias: np.ndarray
    weights: np.ndarray
    shift: np.ndarray

    @classmethod
    def new(cls, languages: list[str], seed: int = 0) -> ByteNet:
        rng = np.random.default_rng(seed)
        kernels = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        return cls(languages, kernels, np.zeros(n, np.float32), rng.normal(0, 0.3, (n, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What a pair of bytes adds at a filter's first two places, and at its next two."""
        k2, k3, k4 = self.kernels
        first = np.concatenate([(k[0][:, None] + k[1][None]).reshape(65536, FILTERS) for k in (k2, k3, k4)], axis=1)
        blank = np.zeros((256, FILTERS), np.float32)
        second = np.concatenate([(k3[2][:, None] + blank[None]).reshape(65536, FILTERS), (k4[2][:, None] + k4[3][None]).reshape(65536, FILTERS)], axis=1)
        return first, second

    def pooled(self, windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        pairs = windows[:, :-1].astype(np.int32) << 8 | windows[:, 1:]
        acc = tables[0][pairs[:, :PLACES]]
        acc[:, :, FILTERS:] += tables[1][pairs[:, 2 : PLACES + 2]]
        return acc.max(axis=1)

    def probabilities(self, windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        hidden = np.maximum(self.pooled(windows, tables) + self.bias, 0)
        logits = hidden @ self.weights + self.shift
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.01, seed: int = 0) -> None:
        """Cross entropy with Adam; through a maximum, only the bytes at its place are adjusted."""
        rng = np.random.default_rng(seed)
        values = [*self.kernels, self.bias, self.weights, self.shift]
        m, v, step = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values], 0
        for epoch in range(epochs):
            for at in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // batch)):
                x, y = windows[at], labels[at]
                pools, places = [], []
                for w, k in zip(WIDTHS, self.kernels):
                    acc = k[0][x[:, :PLACES]]
                    for j in range(1, w):
                        acc = acc + k[j][x[:, j : PLACES + j]]
                    place = acc.argmax(axis=1)
                    pools.append(np.take_along_axis(acc, place[:, None], axis=1)[:, 0])
                    places.append(place)
                raw = np.concatenate(pools, axis=1) + self.bias
                hidden = np.maximum(raw, 0)
                logits = hidden @ self.weights + self.shift
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                back = (p @ self.weights.T) * (raw > 0)
                grads = []
                for i, w in enumerate(WIDTHS):
                    g = np.zeros_like(self.kernels[i])
                    part = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for j in range(w):
                        byte = np.take_along_axis(x, places[i] + j, axis=1)
                        np.add.at(g[j], (byte.ravel(), np.tile(np.arange(FILTERS), len(x))), part.ravel())
                    grads.append(g)
                grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
                step += 1
                for i, (value, g) in enumerate(zip(values, grads)):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    value -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)


def windows_of(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, windows per text): each text in windows without gaps; the last one ends with the text, a short text is filled up with zeros."""
    sizes = np.diff(borders)
    per = np.maximum(1, -(-sizes // WINDOW))
    text = np.repeat(np.arange(len(sizes)), per)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    start = np.maximum(np.minimum(number * WINDOW, sizes[text] - WINDOW), 0)
    place = start[:, None] + np.arange(WINDOW)
    inside = place < sizes[text][:, None]
    at = np.where(inside, borders[text][:, None] + place, 0)
    padded = data if len(data) else np.zeros(1, np.uint8)
    return np.where(inside, padded[at], 0).astype(np.uint8), per


def in_fold(doc_id: str, folds: int = 5):
    """True for rows that are held out from learning: crc32 of the id as text divides by the number of folds; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 400, cuts: int = 4, seed: int = 0) -> ByteNet:
    """A network trained on a bounded sample of the labelled rows that aren't held out.

    About `per_language` documents of every label are chosen by a hash of their ids, `cuts` windows at hashed places in each.
    Only those windows come to the driver, so the sample is bounded by `per_language` and the number of labels. Rows without id, text or label teach nothing; with fewer than two labels the network always answers the one.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~in_fold("doc_id"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts)
    if not names:
        return ByteNet.new(["und"])
    share = F.lit(0.0)
    for name in names:
        share = F.when(F.col("lang") == name, min(1.0, per_language / counts[name])).otherwise(share)
    place = F.xxhash64("doc_id", F.lit("sample")).bitwiseAND((1 << 53) - 1)
    size = F.greatest(F.length("text") - WINDOW // 2, F.lit(1))
    parts = F.array(*[F.substring("text", 1 + F.pmod(F.xxhash64("doc_id", F.lit(j)), size).cast("int"), F.lit(WINDOW)) for j in range(cuts)])
    chosen = rows.where(place / float(1 << 53) < share).select("lang", F.xxhash64("doc_id").alias("order"), parts.alias("parts"))
    chosen = chosen.orderBy("order", "lang", "parts").limit(2 * per_language * len(names)).collect()
    net = ByteNet.new(names, seed)
    texts, labels = [], []
    for r in sorted(chosen, key=lambda r: (r["lang"], r["order"])):
        for part in r["parts"]:
            texts.append(part.encode()[:WINDOW].ljust(WINDOW, b"\0"))
            labels.append(names.index(r["lang"]))
    if texts:
        net.train(np.frombuffer(b"".join(texts), np.uint8).reshape(-1, WINDOW), np.array(labels), seed=seed)
    return net


def predict(docs: DataFrame, net: ByteNet, text: str = "text", certainty: str | None = None) -> DataFrame:
    """The documents with lang_pred and score, the mean probability of that language over all windows of the whole text.

    `und` with score 0 where the text is null or has no letter. Ties go to the language first in order. Every other column is kept; columns that are
    already named lang_pred or score are replaced. With `certainty`, a column of that name has the mean over windows of each window's highest
    probability: unlike the score it is high for a text in several languages, and low only where no window is told.
    """
    marked = docs.drop("lang_pred", "score", "__letters", *([certainty] if certainty else [])).withColumn("__letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    schema = T.StructType([f for f in marked.schema.fields if f.name != "__letters"] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())] + ([T.StructField(certainty, T.DoubleType())] if certainty else []))

    def rows(batches):
        tables = net.tables()
        for batch in batches:
            letters = batch.column("__letters").to_pylist()
            pred, score, sure = [], [], []
            for a, b, data, borders in slices(batch, text):
                windows, per = windows_of(data, borders)
                p = np.concatenate([net.probabilities(windows[i : i + BATCH], tables) for i in range(0, len(windows), BATCH)])
                mean = np.add.reduceat(p, np.cumsum(per) - per, axis=0) / per[:, None]
                best = mean.argmax(axis=1)
                highest = np.add.reduceat(p.max(axis=1), np.cumsum(per) - per) / per
                for i in range(b - a):
                    pred.append(net.languages[best[i]] if letters[a + i] else "und")
                    score.append(float(min(mean[i, best[i]], 1.0)) if letters[a + i] else 0.0)
                    sure.append(float(min(highest[i], 1.0)) if letters[a + i] else 0.0)
            keep = [n for n in batch.schema.names if n != "__letters"]
            found = {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())} | ({certainty: pa.array(sure, pa.float64())} if certainty else {})
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], *found.values()], names=[*keep, *found])

    return marked.mapInArrow(rows, schema)
