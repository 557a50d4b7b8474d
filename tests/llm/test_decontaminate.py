import re

from pyspark.sql import functions as F

from tests.llm.common import ODD, SCHEMA, empty, odd, some_docs
from tidemark.llm import decontaminate as dec


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, bench, window=13):
    grams = {}
    for item, text in bench:
        w = split(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1) if w else ():
            grams.setdefault(tuple(w[i : i + k]), set()).add(item)
    sizes = {len(g) for g in grams}
    out = []
    for d, text in docs:
        w = split(text)
        hit, items = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (own := grams.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    items |= own
        out.append((d, len(w), len(hit), sorted(items)))
    return out


def test_against_brute_force(spark, duck, monkeypatch):
    bench = [(str(i), t) for i, t in duck.sql("SELECT item_id, text FROM benchmark LIMIT 12").fetchall()] + [("s", "short item here"), ("one", "solo"), ("none", " - "), ("null", None), ("again", "short item here")]
    texts = [t for _, t in bench if t]
    docs = ODD + [(200 + i, t) for i, t in some_docs(duck, 60)]
    docs += [(300, f"Before. {texts[0].upper()} after"), (301, texts[1] * 3), (302, "a short  item, here: solo"), (303, " ".join(split(texts[2])[3:17]) + " x"), (304, " ".join(split(texts[2])[3:15]))]
    docs += [(400 + i, f"{i} " + texts[3]) for i in range(30)]
    for chars in (8_000_000, 2_000):  # one block of the benchmark, and several
        monkeypatch.setattr(dec, "BLOCK_CHARS", chars)
        got = dec.matches(spark, spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(bench, "item_id string, text string")).collect()
        key = lambda r: str(r)
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=key) == sorted(brute(docs, bench), key=key)


def test_empty_sides(spark):
    bench = spark.createDataFrame([("a", "some words of a benchmark item")], "item_id string, text string")
    assert dec.matches(spark, empty(spark), bench).count() == 0
    got = dec.matches(spark, odd(spark), bench.limit(0)).collect()
    assert len(got) == len(ODD) and all(r["n_hit"] == 0 and r["items"] == [] for r in got)


def test_many_rows_without_an_id(spark, duck):
    """Twenty thousand rows without an id, half of them one text with a passage: a cost per row, not per pair."""
    bench = [(str(i), t) for i, t in duck.sql("SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 5").fetchall()]
    docs = spark.range(20_000).selectExpr("CAST(NULL AS long) AS doc_id", "id").repartition(4)
    text = F.when(F.col("id") % 2 == 0, F.lit("so " + bench[0][1])).when(F.col("id") % 4 == 1, F.concat(F.lit(bench[1][1] + " "), F.col("id").cast("string"))).otherwise(F.concat(F.lit("other "), F.col("id").cast("string")))
    got = dec.matches(spark, docs.withColumn("text", text).drop("id"), spark.createDataFrame(bench, "item_id string, text string")).groupBy("items").agg(F.count("*").alias("n"), F.min("n_hit").alias("least")).collect()
    assert sorted((r["items"], r["n"], r["least"] > 0) for r in got) == sorted([([], 5000, False), ([bench[0][0]], 10_000, True), ([bench[1][0]], 5000, True)])
