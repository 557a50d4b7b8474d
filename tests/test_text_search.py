"""Text and search operators on hand-written fixtures."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import lexicons as L
from tidemark.operators import cells, joins, postings, scoring, search, termparts, terms, text
from tidemark.functions import texts as X


@pytest.fixture(scope="module")
def trio(spark):
    return spark.createDataFrame([
        (1, "Bitcoin is a decentralized digital currency that lets users send transactions over the blockchain network without a central bank."),
        (2, "The blockchain network records every bitcoin transaction, and the decentralized currency needs no central bank to verify users."),
        (3, "Preheat the oven, then mix flour, butter and sugar before baking the biscuits for twelve minutes on a metal tray.")], "id int, body string")


def test_similarity_trio(spark, trio):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "id_a int, id_b int")
    sims = {(r["id_a"], r["id_b"]): r["similarity"] for r in terms.cosine_pairs(terms.tfidf(trio, "id", "body"), pairs, doc="id").collect()}
    assert sims[(1, 2)] > sims[(1, 3)] and sims[(1, 2)] > sims[(2, 3)]
    asked = trio.where("id = 1").select(F.col("id").alias("q"), "body")
    best = terms.similar_docs(asked, trio, query="q", query_text="body", doc="id", text="body", k=2).orderBy("rank").collect()
    assert [r["id"] for r in best] == [1, 2]


def test_keywords(trio):
    got = {}
    for r in terms.keywords(trio, "id", "body", 5).collect():
        got.setdefault(r["id"], []).append(r["term"])
    assert all(len(v) == 5 for v in got.values()) and any("decentralized" in t or "blockchain" in t for t in got[1])


def test_lexicon_sentiment(spark):
    df = spark.createDataFrame([("Profit and growth surge",), ("Crash, fraud and a lawsuit; growth gone",), ("Nothing here",)], "t string")
    rows = text.lexicon_sentiment(df, "t").collect()
    assert [r["sentiment_label"] for r in rows] == ["POSITIVE", "NEGATIVE", "NEUTRAL"] and rows[2]["sentiment_score"] == 0.5
    assert rows[1]["sentiment_score"] == pytest.approx(0.25)


def test_document_risk(spark):
    df = spark.createDataFrame([("Fully registered, audited and licensed.",), ("A ponzi scheme and rug pull; pump and dump, illegal.",), ("fraudulent is not the word",)], "t string")
    rows = text.document_risk(df, "t").collect()
    assert [r["risk_score"] for r in rows] == [0.0, 100.0, 10.0]
    assert rows[1]["triggered"] == ["rug pull", "ponzi", "illegal", "pump and dump"] and rows[1]["risk_category"] == "Very High"


def test_rollup_sentences(spark):
    df = spark.createDataFrame([("d", "good", "POSITIVE", 0.9), ("d", "meh", "NEUTRAL", 0.4), ("e", "a", "POSITIVE", 0.5), ("e", "b", "NEGATIVE", 0.48)], "doc string, sentence string, label string, score double")
    rows = {r["doc"]: r for r in text.rollup_sentences(df, "doc").collect()}
    assert rows["d"]["label"] == "POSITIVE" and rows["d"]["score"] == 0.96 and rows["d"]["explanation"] == "good"
    assert rows["e"]["label"] == "NEUTRAL" and rows["e"]["score"] == 0.45


def test_aspect_and_classify(spark):
    df = spark.createDataFrame([("The plaintiff went to court over a token sale",), ("Our whitepaper explains the tokenomics and the roadmap",), ("zzz",)], "t string")
    assert [r["document_type"] for r in text.classify_docs(df, "t").collect()] == ["legal_case", "whitepaper", "other"]
    assert [r["a"] for r in df.select(text.aspect("t").alias("a")).collect()][2] == "GENERAL"


def test_mentions_positions(spark):
    df = spark.createDataFrame([(1, "Ada met Bob. ADA left. Bob stayed, ada")], "id int, t string")
    got = sorted((r["entity"], r["start"], r["end"]) for r in joins.mentions(df, ["Ada", "Bob"], doc="id", text="t").collect())
    assert got == [("Ada", 0, 3), ("Ada", 13, 16), ("Ada", 35, 38), ("Bob", 8, 11), ("Bob", 23, 26)]
    edges = {(r["src"], r["dst"]): r["weight"] for r in joins.proximity_join(joins.mentions(df, ["Ada", "Bob"], doc="id", text="t"), doc="id").collect()}
    assert edges == {("Ada", "Bob"): 6, ("Bob", "Ada"): 6}


@pytest.mark.parametrize("q", [1, 3, 5])
def test_substring_join_against_brute_force(spark, q):
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcUSD"), n))
    symbols = sorted({word(rng.integers(1, 12)) for _ in range(80)} | {"BTCUSD", "XBTUSD", "aaaaaaaaaa"})
    names = sorted({word(rng.integers(1, 6)) for _ in range(60)} | {"btc", "usd", "aa", "aaaaaaaaaaa", "zz", "A"}) + ["", None]
    a = spark.createDataFrame([(n, i) for i, n in enumerate(names)] + [("btc", 99)], "name string, i int")
    b = spark.createDataFrame([(s,) for s in symbols] + [("BTCUSD",), ("",), (None,)], "symbol string")
    from tidemark.functions.symbols import norm_symbol

    base = {r["symbol"]: r["base"].lower() for r in b.where("length(symbol) > 0").select("symbol", norm_symbol(F.col("symbol"), "base").alias("base")).collect()}
    got = {(r["i"], r["name"]): r["symbol"] for r in joins.substring_join(a, b, "name", "symbol", q=q).collect()}
    for i, n in [*enumerate(names), (99, "btc")]:
        fits = sorted((base[s] != n.lower(), s) for s in symbols if n and n.lower() in s.lower())
        assert got[(i, n)] == (fits[0][1] if fits else None), n


def test_classify_questions(spark):
    cats = {"market_price": ["price", "drop"], "risk": ["risk", "scam"], "team_background": ["founder"]}
    df = spark.createDataFrame([("What was the price of bitcoin last year?",), ("Compare the risk of solana and cardano",), ("Will it rain?",)], "q string")
    rows = text.classify_questions(df, "q", cats).collect()
    assert [r["primary_category"] for r in rows] == ["market_price", "risk", "general"]
    assert [r["question_type"] for r in rows] == ["factual", "comparative", "yes_no"]
    assert rows[0]["temporality"] == "past" and rows[0]["time_period"] == "last_year" and rows[0]["entities"] == ["bitcoin"]
    assert rows[1]["is_comparison"] is True and rows[2]["is_comparison"] is False
    assert rows[2]["temporality"] == "future"


def test_fund_text(spark):
    body = "Fund Name: Blue Harbor\nAUM: $1.5 billion\nManagement Fee: 2%\nPerformance Fee: 20% (high water mark)\nLock-up: 12 months\nSharpe Ratio: 1.8\n2023: +12.5%\n2024: -3%\nRisk Score: 7/10\n"
    row = text.fund_fields(spark.createDataFrame([(body,)], "t string"), "t").first()
    assert (row["fund_name"], row["aum"], row["management_fee"], row["performance_fee"], row["sharpe_ratio"], row["risk_rating"]) == ("Blue Harbor", 1500.0, 0.02, 0.2, 1.8, 7.0)
    assert [(y["year"], round(y["value"], 4)) for y in row["yearly_returns"]] == [("2023", 0.125), ("2024", -0.03)]
    assert spark.range(1).select(scoring.lock_up_months(F.lit("2 years")).alias("m")).first()["m"] == 24


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(11)
    return spark.createDataFrame([(i, [float(x) for x in rng.normal(size=16)]) for i in range(400)], "id long, v array<float>").repartition(5).persist()


def test_knn_blocks_agree_with_brute_force(spark, points, monkeypatch):
    asked = points.where("id < 40").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    opts = dict(query="q", query_vec="qv", item="id", vec="v", k=5)
    one = sorted(map(tuple, search.knn(asked, points, **opts).collect()))
    monkeypatch.setattr(search, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(search, "BLOCK_ITEMS", 50)
    two = sorted(map(tuple, search.knn(asked, points, **opts).collect()))
    assert one == two and len(one) == 200
    pdf = points.toPandas().sort_values("id")
    m = np.vstack(pdf["v"]).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argsort(-(m[3] @ m.T))[:5]
    assert [r[1] for r in sorted((x for x in one if x[0] == 3), key=lambda x: x[3])] == best.tolist()


@pytest.mark.parametrize("d", ["sf0.01", "sf0.1"])
def test_sketch_recall_at_the_registered_settings(spark, d):
    from tidemark.plans.text_queries import query_vectors, vectors

    v, q = vectors(spark, f"/root/testdata/{d}"), query_vectors(spark, f"/root/testdata/{d}")
    opts = dict(query="item_id", query_vec="embedding", item="vec_id", vec="embedding", k=10)
    exact = {(r["query_id"], r["item_id"]) for r in search.knn(q, v, **opts).collect()}
    close = {(r["query_id"], r["item_id"]) for r in search.knn_sketch(q, v, **opts).collect()}
    assert len(exact & close) / len(exact) >= 0.9


def clustered(spark, n=3000, groups=60, d=24):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(groups, d))
    return spark.createDataFrame([(i, [float(x) for x in centers[i % groups] + 0.35 * rng.normal(size=d)]) for i in range(n)], "id long, v array<float>").repartition(5)


def measured(spark, vectors, asked, exact, **options):
    near = cells.knn_cells(asked, vectors, cells.fit_cells(vectors, item="id", vec="v", cells=32, **options), query="q", query_vec="qv", item="id", vec="v", k=10).collect()
    found = {(r["query_id"], r["item_id"]) for r in near}
    return len(found & exact) / len(exact), np.mean([r["opened"] for r in near]), near


def test_cells_open_few_items_of_clustered_vectors(spark, monkeypatch):
    vectors = clustered(spark).persist()
    asked = vectors.where("id % 40 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    exact = {(r["query_id"], r["item_id"]) for r in search.knn(asked, vectors, query="q", query_vec="qv", item="id", vec="v", k=10).collect()}
    recall, opened, near = measured(spark, vectors, asked, exact)
    assert recall >= 0.9 and opened < 300  # a tenth of all items
    assert sorted(r["rank"] for r in near if r["query_id"] == 0) == list(range(1, 11))
    # Slices of cells and blocks of queries change nothing.
    monkeypatch.setattr(cells, "BLOCK_ITEMS", 20)
    monkeypatch.setattr(cells, "BLOCK_QUERIES", 16)
    again = measured(spark, vectors, asked, exact)
    assert sorted(map(tuple, again[2])) == sorted(map(tuple, near))
    # More probes find more, at a price; all cells find what sketches of all items would.
    whole = measured(spark, vectors, asked, exact, probes=32)
    assert whole[1] == 3000 and whole[0] >= recall - 0.01


def test_cells_of_odd_tables(spark, points):
    none = points.limit(0)
    asked = points.where("id < 3").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    options = dict(query="q", query_vec="qv", item="id", vec="v", k=5)
    assert cells.knn_cells(asked, none, cells.fit_cells(none, item="id", vec="v"), **options).count() == 0
    odd = points.unionByName(spark.createDataFrame([(900, None), (901, [0.0] * 16)], "id long, v array<float>")).unionByName(points.where("id = 7"))
    coarse = cells.fit_cells(odd, item="id", vec="v", cells=4)
    got = cells.knn_cells(asked.unionByName(spark.createDataFrame([(5, None)], "q long, qv array<float>")), odd, coarse, **options).collect()
    assert {r["query_id"] for r in got} == {0, 1, 2} and all(r["item_id"] == r["query_id"] for r in got if r["rank"] == 1) and 900 not in {r["item_id"] for r in got}
    assert (cells.fit_cells(odd, item="id", vec="v", cells=4).centroids == coarse.centroids).all()


@pytest.mark.parametrize("d", ["sf0.01", "sf0.1"])
def test_cell_recall_at_the_registered_settings(spark, d):
    """Vectors without clusters: about half of the items lie in opened cells, a twentieth (at sf0.1) is compared exactly."""
    from tidemark.plans.text_queries import query_vectors, vectors

    v, q = vectors(spark, f"/root/testdata/{d}"), query_vectors(spark, f"/root/testdata/{d}")
    opts = dict(query="item_id", query_vec="embedding", item="vec_id", vec="embedding", k=10)
    exact = search.knn(q, v, **opts)
    near = cells.knn_cells(q, v, cells.fit_cells(v, item="vec_id", vec="embedding"), **opts).persist()
    report = cells.recall_report(near, exact).first()
    share = near.agg(F.avg("opened")).first()[0] / v.count()
    print(d, report, share)
    assert report["recall"] >= 0.9 and share < 0.75


def test_pattern_lists_are_whole():
    assert len(set(L.STOPWORDS)) == len(L.STOPWORDS) and X.word_key("Anti-Money Laundering") == " anti  money  laundering "


def test_hybrid_blocks_agree(spark, monkeypatch):
    from tests.conftest import SMALL
    from tidemark.plans.text_queries import hybrid_inputs

    options, asked, both = hybrid_inputs(spark, SMALL)
    whole = sorted(map(tuple, search.hybrid_search(asked, both, **options).collect()))
    monkeypatch.setattr(search, "BLOCK_ITEMS", 60)
    parts = sorted(map(tuple, search.hybrid_search(asked, both, **options).collect()))
    assert whole == parts and len(whole) > 0


LONG_LIST = ["aa", "aba", "ETH", "smart contract", "é字", "", "a", "aa"] + [f"w{i}" for i in range(5000)]
LONG_TEXTS = ["aaaa ababa eth ETHER smart  contract; smart-contract smart contracts", "w1 w12, w123 w4999 w5000 é字é字", "", None, "zzz", "w7 " * 3000 + "aaaaa"]


@pytest.mark.parametrize("match", ["substring", "word"])
def test_long_dictionaries(spark, match):
    """Five thousand terms in one walk give what one term after the other gives."""
    df = spark.createDataFrame(list(enumerate(LONG_TEXTS)), "id int, t string")
    got = sorted((r["id"], r["category"], r["term"], r["n"]) for r in joins.lexicon_join(df, {"c": LONG_LIST[:7], "d": LONG_LIST[7:]}, doc="id", text="t").collect()) if match == "substring" else None
    plain = {}
    for i, t in enumerate(LONG_TEXTS):
        body = (t or "").lower() if match == "substring" else " " + re.sub(r"[^\w]+", "  ", (t or "").lower()) + " "
        for at, term in enumerate(LONG_LIST):
            n = body.count(term.lower() if match == "substring" else X.word_key(term)) if term else 0
            if n:
                plain[i, at] = n
    if got is not None:
        assert got == sorted((i, "c" if at < 7 else "d", LONG_LIST[at], n) for (i, at), n in plain.items())
    b = df.select("id", X.prepared("t", match).alias("b"))
    rows = b.select("id", X.total_count(F.col("b"), LONG_LIST, match).alias("n"), X.found_terms(F.col("b"), LONG_LIST, match).alias("f"), X.any_term(F.col("b"), LONG_LIST, match).alias("any")).collect()
    for r in rows:
        mine = {at: n for (i, at), n in plain.items() if i == r["id"]}
        assert r["n"] == sum(mine.values()) and r["f"] == [LONG_LIST[at] for at in sorted(mine)] and r["any"] == bool(mine)


def test_long_point_lists(spark):
    points = {"smart contract": 30, "eth": -25} | {f"w{i}": i % 3 for i in range(5000)}
    df = spark.createDataFrame(list(enumerate(LONG_TEXTS)), "id int, t string")
    got = {r["id"]: r for r in text.document_risk(df, "t", points).collect()}
    assert got[0]["risk_score"] == 15.0 and got[0]["triggered"] == ["smart contract", "eth"] and got[1]["risk_score"] == 10.0 + 1 + 0 + 0 + 1
    assert got[2]["risk_score"] == got[3]["risk_score"] == 10.0 and got[3]["triggered"] == []
    both = text.lexicon_sentiment(df, "t", positive=["contract", *points], negative=["zzz"]).orderBy("id").collect()
    assert [r["n_negative"] for r in both] == [0, 0, 0, 0, 1, 0] and both[5]["n_positive"] == 3000


def test_blocks_that_cannot_matter_stay_closed(spark):
    """The rows of plain scoring, from fewer postings; also for null ids, ties, repeated rows, unknown words and more results than documents."""
    from tidemark.operators import postings

    rows = [(i, " ".join(["common"] * (1 + i % 7) + [f"rare{i % 40}"] * (1 + i % 3) + [f"word{i % 5}", "frequent"] * (i % 4))) for i in range(800)]
    rows += [(None, "common rare1"), (None, "rare1 rare1 word2 common"), (5, "common"), (900, ""), (901, None), (902, "common rare3"), (903, "common rare3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "common rare1 word2"), (2, "rare3 frequent common"), (3, "unheard"), (4, ""), (5, None), (None, "rare7 common frequent word1"), (6, "common")], "q long, t string")
    opts = dict(query="q", query_text="t", doc="doc_id", text="text")
    for k in (1, 3, 2000):
        plain, blocks = (sorted((str(r["q"]), str(r["doc_id"]), r["rank"], round(r["bm25"], 8)) for r in f(asked, docs, k=k, **opts).collect()) for f in (search.bm25, search.bm25_blocks))
        assert plain == blocks and len(plain) >= 4 * min(k, 20)
    terms = search._asked(asked, "q", "t", ("the",))
    index = postings.term_postings(docs, doc="doc_id", text="text", wanted=terms)
    plan = postings.plan_blocks(postings.banded(postings.bm25_impacts(index, "doc_id"), "doc_id"), postings.bm25_weights(index, terms), query="q", doc="doc_id", k=3)
    opened, closed = (plan.where(f"skipped = {s}").agg({"n": "sum"}).first()[0] or 0 for s in ("false", "true"))
    assert closed > opened
    assert bool(search.bm25_blocks(asked, docs.limit(0), k=3, **opts).isEmpty()) and bool(search.bm25_blocks(asked.limit(0), docs, k=3, **opts).isEmpty())


def test_hybrid_against_all_pairs(spark):
    """Vectors fetched for few documents give the rows that vectors of all documents give; also without vectors, without words and in short lists."""
    import numpy as np

    gen = np.random.default_rng(3)
    vec = lambda: [float(x) for x in gen.standard_normal(6)]
    rows = [(i, " ".join(f"word{j}" for j in gen.integers(0, 60, 12)), vec() if i % 5 else None) for i in range(300)] + [(400, None, vec()), (401, "", None)]
    asked = [(1, "word1 word2 word3", vec()), (2, "word4 word5", None), (3, "nothing", vec()), (4, "", None)]
    docs, qs = spark.createDataFrame(rows, "d long, text string, v array<double>"), spark.createDataFrame(asked, "q long, t string, v array<double>")
    opts = dict(query="q", query_text="t", query_vec="v", doc="d", text="text", vec="v")
    scores = {(r["q"], r["d"]): r["bm25"] for r in search.bm25_scores(qs, docs, query="q", query_text="t", doc="d", text="text").collect()}
    for k, alpha in ((5, 0.5), (3, 0.2), (400, 0.5)):
        want = []
        for q, _, v in asked:
            sims = {d: float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)) for d, _, w in rows if v and w}
            words = {d: s for (a, d), s in scores.items() if a == q}

            def part(x, of):
                lo, hi = (min(of.values()), max(of.values())) if of else (0, 0)
                return 0.0 if x not in of else (of[x] - lo) / (hi - lo) if hi > lo else 1.0

            ranked = sorted((-(alpha * part(d, sims) + (1 - alpha) * part(d, words)), d) for d in sims.keys() | words.keys())[:k]
            want += [(q, d, round(-s, 6)) for s, d in ranked]
        got = sorted((r["query_id"], r["doc_id"], round(r["score"], 6)) for r in search.hybrid_search(qs, docs, k=k, alpha=alpha, **opts).collect())
        assert [g[:2] for g in got] == [w[:2] for w in sorted(want)] and np.allclose([g[2] for g in got], [w[2] for w in sorted(want)], atol=2e-6)


def test_text_parts_follow_characters(spark, monkeypatch):
    """Texts are spread over tasks by their characters, also where Spark would join small partitions again."""
    monkeypatch.setattr(terms, "CHARS", 1000)
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.repeat(F.lit("coin mining "), 100).alias("text"))
    parts = terms.spread(docs, "doc_id", "text").groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.length("text")).alias("chars")).collect()
    assert terms.text_parts(docs, "text") == 120 and len(parts) > 40 and max(r["chars"] for r in parts) < 10_000
    assert {(r["term"], r["n"]) for r in terms.term_freq(terms.spread(docs, "doc_id", "text"), "doc_id", "text").select("term", "n").distinct().collect()} == {("coin", 100), ("mining", 100), ("coin mining", 100), ("mining coin", 99)}
    assert terms.text_parts(docs.limit(0), "text") == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_runs_count_terms_in_their_row(spark):
    got = terms.runs(spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["x"])], "id int, t array<string>"), "t").collect()
    assert {r["id"]: r["t"] and [tuple(x) for x in r["t"]] for r in got} == {1: [("a", 1), ("b", 2)], 2: [], 3: None, 4: [("x", 1)]}


def test_keywords_count_in_rows_and_over_rows(spark):
    """A text in one row is answered there, the same text cut over two rows of one id is added up; both agree, and only shared ids are unfolded."""
    head, tail = "coin mining coin mining token token staking wallet exchange bridge ", "oracle token wallet coin mining validator ledger custody"
    docs = spark.createDataFrame([(1, head + ". of " + tail), (2, head), (2, tail), (None, head), (None, tail), (4, "of the and in to a it")], "doc_id int, text string")
    got = {}
    for r in terms.keywords_count(docs, "doc_id", "text", 7, boost=["staking"], min_chars=5).collect():
        got.setdefault(r["doc_id"], {})[r["rank"]] = (r["term"], r["n"])
    assert set(got) == {1, 2, None} and got[1] == got[2] and sorted(got[1]) == list(range(1, 8))
    assert [got[1][i] for i in (1, 2, 3)] == [("coin mining", 3), ("staking wallet", 2), ("token staking", 2)]
    assert not {"coin", "mining", "staking"} & {t for t, _ in got[1].values()} and ("exchange", 1) in got[1].values()
    rows = terms.keywords_count(docs.where("doc_id = 1"), "doc_id", "text", 7, min_chars=5)
    assert "sort_array" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_tfidf_stays_in_parts(spark, monkeypatch):
    """Parts give the weights of the plain join, also for rows that share an id or have none; terms of documents meet inverse frequencies without a join."""
    monkeypatch.setattr(terms, "PART_CHARS", 300, raising=False)
    texts = [f"coin mining pool w{i % 7} w{i % 3} only{i} coin" for i in range(60)]
    rows = [*enumerate(texts), (3, "coin coin mining alpha beta gamma delta"), (None, "coin same same"), (None, "mining same coin"), (70, None), (71, ""), (72, "of the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for bigrams in (True, False):
        got = terms.tfidf(docs, "doc_id", "text", bigrams=bigrams)
        weights = terms.idf(docs, "doc_id", "text", bigrams=bigrams).select("term", "idf")
        want = terms.term_freq(docs, "doc_id", "text", bigrams=bigrams).join(weights, "term").select("doc_id", "term", F.col("tf") * F.col("idf"))
        assert sorted(((r[0], r[1], round(r[2], 12)) for r in got.collect()), key=str) == sorted(((r[0], r[1], round(r[2], 12)) for r in want.collect()), key=str)
        assert got.select("doc_id", F.spark_partition_id().alias("p")).distinct().groupBy("doc_id").count().where("count > 1").count() == 0
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert terms.tfidf(docs.limit(0), "doc_id", "text").count() == 0


def test_tfidf_moves_texts_once_and_terms_as_numbers(spark, monkeypatch):
    """Texts are shuffled once for all steps, no term is unfolded before weights are known, and messages are far smaller than the terms in them; words of any script, and words that begin others."""
    monkeypatch.setattr(terms, "PART_CHARS", 400, raising=False)
    odd = ["ab abc ab abcd ab_ coin coins co_in 数据分 数据分析 x² Straße ÉTÉ été İstanbul", "abc ab-abc ab'abc coin coin été 𝒳𝒳𝒳 𝒳𝒳𝒳𝒳 ½½½", "abc", "abc " * 200]
    rows = [(i, " ".join(f"{odd[i % 4]} word{i * 7 % 50} word{i * 11 % 50}".split() * (1 + i % 3))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = terms.tfidf(docs, "doc_id", "text")
    weights = terms.idf(docs, "doc_id", "text").select("term", "idf")
    want = terms.term_freq(docs, "doc_id", "text").join(weights, "term").select("doc_id", "term", F.col("tf") * F.col("idf"))
    assert sorted((r[0], r[1], round(r[2], 12)) for r in got.collect()) == sorted((r[0], r[1], round(r[2], 12)) for r in want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and "Generate" not in plan and "Window" not in plan and plan.count("FileScan") + plan.count("Scan ExistingRDD") == 1
    numbers = np.arange(1000) * 3 + 1
    assert np.array_equal(termparts.unpack(termparts.pack(numbers)), numbers) and len(zlib.compress(termparts.pack(np.diff(numbers)))) < 100


def test_tfidf_deals_large_ids_over_parts(spark, monkeypatch):
    """Rows that share an id, or have none, and hold more text than a part are dealt over parts by their texts; their counts and keywords are those of the whole document."""
    monkeypatch.setattr(terms, "PART_CHARS", 600, raising=False)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"coin mining pool word{i % 11} word{i % 5} only{i} token{i % 2}") for i in range(150)] + [(2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = terms.tfidf(docs, "doc_id", "text")
    weights = terms.idf(docs, "doc_id", "text").select("term", "idf")
    want = terms.term_freq(docs, "doc_id", "text").join(weights, "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("weight"))
    assert sorted((str(r[0]), r[1], round(r[2], 12)) for r in got.collect()) == sorted((str(r[0]), r[1], round(r[2], 12)) for r in want.collect())
    assert "Aggregate" in got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in terms.tfidf(docs.where("doc_id > 7"), "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    best = Window.partitionBy("doc_id").orderBy(F.round("weight", 12).desc(), F.col("term"))
    first = want.withColumn("rank", F.row_number().over(best)).where("rank <= 4 AND doc_id IS NOT NULL").select("doc_id", "term", "rank")
    keys = terms.keywords(docs, "doc_id", "text", 4, boost=[], min_chars=5).select("doc_id", "term", "rank")
    assert sorted(map(tuple, keys.collect())) == sorted(map(tuple, first.collect()))


def test_keywords_leave_their_task_chosen(spark):
    """Only chosen keywords are shuffled: the filter on length, which needs its documents' ids, comes after the choice; short texts and rows without an id give none."""
    long = "coin mining coin mining token token staking wallet exchange bridge oracle token wallet validator ledger custody coin miner"
    docs = spark.createDataFrame([(1, long), (2, "coin token"), (2, long), (3, "coin token"), (None, long), (4, None)], "doc_id int, text string")
    got = terms.keywords(docs, "doc_id", "text", 3, boost=["staking"])
    rows = {}
    for r in got.collect():
        rows.setdefault(r["doc_id"], []).append(r["rank"])
    assert {d: sorted(x) for d, x in rows.items()} == {1: [1, 2, 3], 2: [1, 2, 3]}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("WindowGroupLimit")


def test_keywords_hold_back_light_terms(spark, monkeypatch):
    """A part makes rows only of terms that can be chosen, also where very many weigh the same; the choice is that among all weights."""
    monkeypatch.setattr(terms, "PART_CHARS", 2000, raising=False)
    texts = [" ".join(f"w{(i * 31 + j * j) % 97:02d}{'token' if (i + j) % 29 == 0 else ''}" for j in range(30 + 3 * i)) for i in range(40)] + [" ".join(f"only{j:03d}" for j in range(300))] * 2
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[7]), (None, texts[5]), (90, "two words"), (91, None)], "doc_id long, text string").repartition(4)
    for boost, k in ((("token", "smart w"), 5), ((), 1), (("n", "w1"), 12)):
        everything = terms.tfidf(docs, "doc_id", "text")
        boosted = F.lit(False)
        for word in boost:
            boosted = boosted | F.col("term").contains(word)
        order = [F.round(F.when(boosted, F.col("weight") * 1.5).otherwise(F.col("weight")), 12).desc(), F.col("term")]
        want = everything.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where(F.col("rank") <= k)
        held = terms.tfidf(docs, "doc_id", "text", heaviest=(k, boost, 1.5))
        chosen = held.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where(F.col("rank") <= k)
        assert sorted(map(str, chosen.collect())) == sorted(map(str, want.collect()))
        most = held.groupBy("doc_id").count().agg(F.max("count")).first()[0]
        assert most <= 4 * k < everything.groupBy("doc_id").count().agg(F.max("count")).first()[0] / 5


def test_cosine_pairs_follow_rows(spark, monkeypatch):
    """Joins of weights have as many tasks as their rows ask for; pairs without a document, without an id or of one document are answered."""
    monkeypatch.setattr(terms, "PAIR_ROWS", 50, raising=False)
    vectors = spark.createDataFrame([(d, f"t{(d * 3 + i) % 40}", 0.1 * (1 + (d + i) % 7)) for d in range(30) for i in range(10)], "d long, term string, weight double")
    wanted = [(i, j) for i in range(0, 30, 2) for j in range(30)] + [(1, 99), (98, 2), (98, 99), (None, 1)]
    pairs = spark.createDataFrame(wanted, "id_a long, id_b long")
    weights = {}
    for r in vectors.collect():
        weights.setdefault(r["d"], {})[r["term"]] = r["weight"]

    def cosine(x, y):
        x, y = weights.get(x, {}), weights.get(y, {})
        dot = sum(w * y.get(t, 0.0) for t, w in x.items())
        return dot / (sum(w * w for w in x.values()) ** 0.5 * sum(w * w for w in y.values()) ** 0.5) if dot else 0.0

    for parts, tasks in ((None, 6), (9, 9)):
        got = terms.cosine_pairs(vectors, pairs, doc="d", parts=parts)
        assert sorted(((r["id_a"], r["id_b"], round(r["similarity"], 9)) for r in got.collect()), key=str) == sorted(((x, y, round(cosine(x, y), 9)) for x, y in wanted), key=str)
        dealt = [line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "RepartitionByExpression [d#" in line]
        assert len(dealt) == 2 and all(line.endswith(f", {tasks}") for line in dealt)


def test_keyword_hits_are_counted_where_texts_are(spark, monkeypatch):
    """Texts are dealt out by their characters before they are unfolded."""
    monkeypatch.setattr(terms, "CHARS", 1000)
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.repeat(F.lit("coin mining "), 100).alias("text"))
    asked = spark.createDataFrame([(1, "coin gold"), (2, "coin mining")], "q int, t string")
    hits = search.keyword_hits(asked, docs, query="q", query_text="t", doc="doc_id", text="text")
    assert "RepartitionByExpression [doc_id" in hits._jdf.queryExecution().optimizedPlan().toString() and hits.groupBy("q").agg(F.sum("hits")).orderBy("q").collect() == [(1, 100), (2, 200)]


def test_postings_are_not_shuffled_by_term(spark, monkeypatch):
    """Wanted terms are written first and so known to be small: terms are filtered and counted where their texts are."""
    plans, write = {}, postings.written
    monkeypatch.setattr(postings, "written", lambda df, label: plans.update({label: df}) or write(df, label))
    docs = spark.range(50).select(F.col("id").alias("d"), F.concat(F.lit("coin mining "), F.col("id").cast("string")).alias("t"))
    asked = spark.createDataFrame([(1, "coin gold")], "q int, t string")
    scores = search.bm25_scores(asked, docs, query="q", query_text="t", doc="d", text="t")
    assert scores.count() == 50 and list(plans) == ["wanted", "postings", "weights"]
    assert "hashpartitioning(term" not in plans["postings"]._jdf.queryExecution().executedPlan().toString()


def test_similar_docs_sums_products_where_texts_are(spark, monkeypatch, trio):
    """What is asked for is written and so known to be small; only norms need the weights of all terms."""
    sizes, write = {}, terms.written
    monkeypatch.setattr(terms, "written", lambda df, label: sizes.update({label: (out := write(df, label)).count()}) or out)
    asked = spark.createDataFrame([(1, "central bank zeppelin"), (2, "flour"), (3, "the of")], "q int, body string")
    found = terms.similar_docs(asked, trio, query="q", query_text="body", doc="id", text="body", k=5)
    assert {(r["q"], r["id"]) for r in found.collect()} == {(1, 1), (1, 2), (2, 3)}
    assert set(sizes) == {"idf", "asked"} and sizes["asked"] == 4
