import zlib
from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm import test_decontaminate, test_near, test_secrets
from tests.llm.common import ODD, SCHEMA, empty, odd, some_docs
from tidemark.llm import langid
from tidemark.llm.tokens import encoder, vocabulary


def test_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert 0.5 * n < docs.count() <= n
        n = docs.count()
    ids = [r["doc_id"] for r in docs.collect()]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r["doc_id"] for r in pieces.collect()} == set(ids)


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_odd_documents(spark):
    for rows in (odd(spark), empty(spark)):
        docs = rows.withColumnRenamed("n", "lang")
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SMALL).count()


INTERNAL = ["score", "lang_pred", "certainty", "__certainty", "__letters", "id", "body", "rest", "hash", "one", "n", "keep_id", "keep_hash", "found", "found_id", "found_hash", "bad_id", "bad_hash", "__text", "__id", "__hash",
            "__spans", "text_hash", "class", "none", "hits", "with space"]


def test_columns_of_any_name_come_back(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60").withColumns({c: F.concat(F.lit(c + " "), F.col("doc_id").cast("string")) for c in INTERNAL})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c} {r['doc_id']}" for r in rows for c in INTERNAL), name
    only = docs.select("text", "doc_id", "lang")
    assert all(stage(spark, only, SMALL).columns == only.columns for _, stage in corpus_pipeline.STAGES[:-1])


def test_texts_in_several_languages_stay(spark, monkeypatch):
    net = langid.ByteNet.new(list("abcdef"))  # told by one letter each; nothing of them in a text means equal probabilities
    for k in (*net.kernels, net.weights):
        k[:] = 0
    for i, c in enumerate(b"abcdef"):
        net.kernels[0][0, c, i], net.weights[i, i] = 10, 10
    monkeypatch.setattr(langid, "learn", lambda docs: net)
    rows = [(1, "".join(c * 256 for c in "abcdef")), (2, "xyz " * 500), (3, "c" * 256 + "d" * 600), (4, None), (5, "12 34"), (6, "")]
    kept = corpus_pipeline.identify_language(spark, spark.createDataFrame([(*r, None) for r in rows], SCHEMA + ", lang string"), SMALL).collect()

    def plain(text):
        parts = [text[at : at + 256] for at in range(0, len(text), 256)]
        return sum(max(1.0 if c in p else 1 / 6 for c in "abcdef") for p in parts) / len(parts)

    assert sorted(r["doc_id"] for r in kept) == [d for d, t in rows if t and any(c.isalpha() for c in t) and plain(t) >= 0.3] == [1, 3]
    assert {r["doc_id"]: r["lang"] for r in kept}[3] == "d"


def test_near_duplicates_against_brute_force(spark, duck):
    rows = some_docs(duck, 60)
    for i, n in enumerate(range(40, 240, 10)):  # one word changed every so often: similarity from 0.80 to 0.85
        words = [f"p{i}x{j}" for j in range(n)]
        changed = max(1, round(n * 0.096 / 5))
        rows += [(10_000 + 2 * i, " ".join(words)), (10_001 + 2 * i, " ".join("y" + w if j % (n // changed) == n // changed // 2 and j // (n // changed) < changed else w for j, w in enumerate(words)))]
    pairs = [(test_near.shingles(a[1]), test_near.shingles(b[1])) for a, b in zip(rows[60::2], rows[61::2])]
    shares = [len(a & b) / len(a | b) for a, b in pairs]
    assert sum(0.8 <= s < 0.85 for s in shares) >= 10
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), SMALL).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(d for d, n, low in test_near.brute(rows, 80) if d == low or not n)


def test_contamination_against_brute_force(spark, duck):
    bench = duck.sql("SELECT item_id::VARCHAR, text FROM benchmark").fetchall()
    rows = some_docs(duck) + [(10_000, f"before {bench[0][1]} after"), (10_001, bench[1][1] + " pad" * 2000)]
    kept = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), SMALL).collect()
    want = [d for d, n, hit, _ in test_decontaminate.brute(rows, bench) if not (hit and 20 * hit >= n)]
    assert sorted(r["doc_id"] for r in kept) == sorted(want) and 10_000 not in want and 10_001 in want


def test_masks_against_plain_version(spark, duck):
    rows = some_docs(duck) + [(10_000 + i, t) for i, t in test_secrets.CASES + [(50, test_secrets.ENV)]]

    def masked(text):
        out, end = "", 0
        for s, e in sorted((s, e) for _, s, e in test_secrets.linked(text or "")):
            if s >= end:
                out += text[end:s] + "[SECRET]"
            end = max(end, e)
        return out + text[end:]

    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.mask_secrets(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), SMALL).collect()}
    assert got == {d: masked(t) for d, t in rows if d != 10_017} | {10_017: got[10_017]}  # Python's (?i) folds letters beyond ASCII


def test_packing_against_whole_texts(spark, duck):
    rows = [r for r in ODD if r[0] not in (None, 5)] + some_docs(duck)
    rows = [(10_000 + i if i < 20 else i, t) for i, t in rows[:9]] + rows[9:]
    tool, got = encoder(vocabulary("word_bpe_49k.json"), True), defaultdict(list)
    for r in corpus_pipeline.pack_sequences(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), SMALL).collect():
        got[r["doc_id"]].append(r)
    for d, text in rows:
        ids, pieces = tool.whole([text or ""])[0] + (1).to_bytes(4, "little"), sorted(got[d], key=lambda r: r["start"])
        assert [r["ids_crc32"] for r in pieces] == [zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) for r in pieces]
        assert sum(r["length"] for r in pieces) == len(ids) // 4
