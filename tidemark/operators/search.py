"""Keyword, vector and hybrid search.

Blocks of queries meet blocks of vectors as two matrices, and every block only passes
on its own best rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from tidemark import scale
from tidemark.functions import texts as X
from tidemark.operators import postings as P
from tidemark.operators import terms as T

#: Queries and items that meet in one task: bounds its memory, whatever the sizes of the tables.
BLOCK_QUERIES, BLOCK_ITEMS = 1024, 8192
#: Hybrid search knows the similarities of this many times ``k`` leading vectors before it fetches any: the further down, the lower the bound for all others.
LEADERS = 10


def _matrix(vectors: pd.Series) -> np.ndarray:
    size = max((len(v) for v in vectors), default=1)
    return np.vstack([np.asarray(v, dtype="float64") if len(v) else np.zeros(size) for v in vectors]) if len(vectors) else np.zeros((0, 1))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _best(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, min_sim: float | None) -> tuple[list, list, list, list]:
    """Best ``k`` ids (ties by id) of one block for every query, and the lowest similarity as a row without an id."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    scores = np.round(_unit(q) @ _unit(v).T, 9)
    for i, qid in enumerate(qids):
        row = scores[i]
        order = np.lexsort((ids, -row))[:k]
        if min_sim is not None:
            order = order[row[order] >= min_sim]
        out[0].extend([qid] * len(order))
        out[1].extend(ids[order].tolist())
        out[2].extend(row[order].tolist())
        out[3].extend([float(row.min())] * len(order))
    return out


def _parts(df: DataFrame, rows: int) -> Column:
    """Number of blocks of about ``rows`` rows, as a scalar of the plan."""
    return df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / rows)).cast("int")).scalar()


def _blockwise(queries: DataFrame, vectors: DataFrame, *, query: str, query_vec: str, item: str, vec: str, k: int, min_sim: float | None) -> DataFrame:
    """(query_id, item_id, similarity, lowest): every block of queries meets every block of items once; each pair of blocks passes on its best rows only."""
    schema = f"query_id {queries.schema[query].dataType.simpleString()}, item_id {vectors.schema[item].dataType.simpleString()}, similarity double, lowest double"
    asked = queries.select(F.col(query).alias("q"), F.col(query_vec).alias("v")).where(F.col("v").isNotNull())
    items = vectors.select(F.col(item).alias("i"), F.col(vec).alias("v")).where(F.col("v").isNotNull())
    n_blocks, n_slices = _parts(asked, BLOCK_QUERIES), _parts(items, BLOCK_ITEMS)
    left = asked.withColumn("b", F.pmod(F.xxhash64("q"), n_blocks).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), n_slices - 1)))
    right = items.withColumn("s", F.pmod(F.xxhash64("i"), n_slices).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), n_blocks - 1)))

    def meet(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(vs):
            return pd.DataFrame({"query_id": [], "item_id": [], "similarity": [], "lowest": []})
        a, i, s, low = _best(qs["q"].to_numpy(), _matrix(qs["v"]), vs["i"].to_numpy(), _matrix(vs["v"]), k, min_sim)
        return pd.DataFrame({"query_id": a, "item_id": i, "similarity": s, "lowest": low})

    return left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInPandas(meet, schema)


def knn(queries: DataFrame, vectors: DataFrame, *, query: str, query_vec: str, item: str, vec: str, k: int, min_sim: float | None = None) -> DataFrame:
    """Exact cosine top-``k`` per query, optionally above a similarity threshold; rows without a vector are left out.

    One plan for all sizes: blocks of queries meet blocks of items in a shuffle, and the
    block counts come from the tables' row counts inside the plan.
    """
    found = _blockwise(queries, vectors, query=query, query_vec=query_vec, item=item, vec=vec, k=k, min_sim=min_sim).drop("lowest")
    return scale.top_per_key(found, "query_id", [F.col("similarity").desc(), F.col("item_id")], k, rank="rank")


@pandas_udf(DoubleType())
def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = _matrix(a), _matrix(b)
    if x.shape[1] != y.shape[1]:  # a batch in which one side has no vector at all
        return pd.Series(np.zeros(len(a)))
    return pd.Series(np.round((_unit(x) * _unit(y)).sum(axis=1), 9))


def sign_sketch(vec: str, *, bits: int = 512, seed: int = 7) -> Column:
    """On which side of ``bits`` fixed random planes a vector lies, packed into bytes."""
    @pandas_udf("binary")
    def sketch(v: pd.Series) -> pd.Series:
        m = _matrix(v)
        planes = np.random.default_rng(seed).standard_normal((bits, m.shape[1]))
        return pd.Series([row.tobytes() for row in np.packbits(m @ planes.T > 0, axis=1)])

    return sketch(F.col(vec))


def knn_sketch(queries: DataFrame, vectors: DataFrame, *, query: str, query_vec: str, item: str, vec: str, k: int, candidates: int | None = None, bits: int = 512, seed: int = 7) -> DataFrame:
    """Approximate top-``k``: sketches of one bit per plane find ``candidates`` (default ten times ``k``) items per query, which are re-ranked exactly.

    Every vector is indexed by its sketch, a small fraction of its size. Blocks of sketches meet like the
    vectors of :func:`knn`, each passing on its nearest items; vectors are only joined to what is left.
    """
    most = candidates or 10 * k
    asked = queries.select(F.col(query).alias("q"), F.col(query_vec).alias("v")).where(F.col("v").isNotNull()).select("q", sign_sketch("v", bits=bits, seed=seed).alias("code"))
    items = vectors.select(F.col(item).alias("i"), F.col(vec).alias("v")).where(F.col("v").isNotNull()).select("i", sign_sketch("v", bits=bits, seed=seed).alias("code"))
    n_blocks, n_slices = _parts(queries, BLOCK_QUERIES), _parts(vectors, BLOCK_ITEMS)
    left = asked.withColumn("b", F.pmod(F.xxhash64("q"), n_blocks).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), n_slices - 1)))
    right = items.withColumn("s", F.pmod(F.xxhash64("i"), n_slices).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), n_blocks - 1)))

    def meet(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(qs) and len(vs):
            ids, codes = vs["i"].to_numpy(), np.frombuffer(b"".join(vs["code"]), np.uint8).reshape(len(vs), -1)
            for q, code in zip(qs["q"], qs["code"]):
                apart = np.bitwise_count(codes ^ np.frombuffer(code, np.uint8)).sum(axis=1, dtype=np.int64)
                near = np.lexsort((ids, apart))[:most]
                out.append(pd.DataFrame({"query_id": [q] * len(near), "item_id": ids[near], "apart": apart[near]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "item_id": [], "apart": []})

    schema = f"query_id {queries.schema[query].dataType.simpleString()}, item_id {vectors.schema[item].dataType.simpleString()}, apart long"
    found = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInPandas(meet, schema)
    found = scale.top_per_key(found, "query_id", [F.col("apart"), F.col("item_id")], most)
    q = queries.select(F.col(query).alias("query_id"), F.col(query_vec).alias("_qv"))
    v = vectors.select(F.col(item).alias("item_id"), F.col(vec).alias("_iv"))
    pairs = found.join(v, "item_id").join(q, "query_id").select("query_id", "item_id", cosine("_qv", "_iv").alias("similarity"))
    return scale.top_per_key(pairs, "query_id", [F.col("similarity").desc(), F.col("item_id")], k, rank="rank")


def keyword_hits(queries: DataFrame, docs: DataFrame, *, query: str, query_text: str, doc: str, text: str, min_len: int = 3) -> DataFrame:
    """(query, document, number of distinct query keywords the document contains).

    Texts are spread by their characters: a task counts the pairs of its own documents only, and counts are not shuffled again.
    """
    docs = T.spread(docs, doc, text)
    asked = queries.select(query, F.explode(F.array_distinct(F.filter(X.words(query_text), lambda w: F.length(w) >= min_len))).alias("_w"))
    index = scale.unnest(docs, [doc], F.array_distinct(X.words(text)), "_w")
    return index.join(asked, "_w").groupBy(query, doc).agg(F.count(F.lit(1)).alias("hits"))


def keyword_search(queries: DataFrame, docs: DataFrame, *, query: str, query_text: str, doc: str, text: str, k: int, min_len: int = 3,
                   step: float = 0.1, cap: float = 0.8) -> DataFrame:
    """The ``k`` documents with most query keywords: 0.1 relevance per keyword, at most 0.8."""
    hits = keyword_hits(queries, docs, query=query, query_text=query_text, doc=doc, text=text, min_len=min_len)
    scored = hits.withColumn("relevance", F.round(F.least(F.lit(cap), F.col("hits") * step), 6))
    return scale.top_per_key(scored, query, [F.col("hits").desc(), F.col(doc)], k, rank="rank")


def _asked(queries: DataFrame, query: str, query_text: str, stopwords: Sequence[str]) -> DataFrame:
    return queries.select(query, F.explode(F.array_distinct(T.tokens(F.col(query_text), stopwords))).alias("term"))


def bm25_scores(queries: DataFrame, docs: DataFrame, *, query: str, query_text: str, doc: str, text: str, k1: float = 1.2, b: float = 0.75,
                stopwords: Sequence[str] = tuple(T.STOPWORDS)) -> DataFrame:
    """(query, document, BM25) for every document that shares a term with the query."""
    asked = _asked(queries, query, query_text, stopwords)
    index = P.term_postings(docs, doc=doc, text=text, stopwords=stopwords, wanted=asked)
    part = F.sum(F.col("weight") * F.col("impact")).alias("bm25")
    weights = P.written(P.bm25_weights(index, asked), "weights")
    return P.bm25_impacts(index, doc, k1=k1, b=b).join(weights, "term").groupBy(query, doc).agg(part)


def bm25(queries: DataFrame, docs: DataFrame, *, query: str, query_text: str, doc: str, text: str, k: int, **options) -> DataFrame:
    """BM25 top-``k`` per query."""
    scores = bm25_scores(queries, docs, query=query, query_text=query_text, doc=doc, text=text, **options)
    return scale.top_per_key(scores, query, [F.round("bm25", 9).desc(), F.col(doc)], k, rank="rank")


def bm25_blocks(queries: DataFrame, docs: DataFrame, *, query: str, query_text: str, doc: str, text: str, k: int, k1: float = 1.2, b: float = 0.75,
                stopwords: Sequence[str] = tuple(T.STOPWORDS)) -> DataFrame:
    """The rows of :func:`bm25`, without scoring blocks of postings that cannot change them.

    Pays where lists are long against ``k``; below that, its further steps cost more than the postings they save.
    """
    asked = _asked(queries, query, query_text, stopwords)
    index = P.term_postings(docs, doc=doc, text=text, stopwords=stopwords, wanted=asked)
    found = P.best(P.bm25_impacts(index, doc, k1=k1, b=b), P.bm25_weights(index, asked), query=query, doc=doc, k=k)
    return scale.top_per_key(found.withColumnRenamed("score", "bm25"), query, [F.round("bm25", 9).desc(), F.col(doc)], k, rank="rank")


def hybrid_search(queries: DataFrame, docs: DataFrame, *, query: str, query_text: str, query_vec: str, doc: str, text: str, vec: str, k: int,
                  alpha: float = 0.5, explain: bool = False) -> DataFrame:
    """alpha * vector + (1 - alpha) * BM25 (alpha from 0 to 1), each min-max scaled per query over all documents that have such a score.

    Documents without a vector, or without a common term, count 0 for that part. The best
    documents either share a term with the query, or lead among all vectors. A document that does not lead has
    at most the last leader's similarity, so vectors are fetched only for those whose BM25 can still
    reach the ``k``-th score known without them. ``explain`` keeps the components.
    """
    deep = LEADERS * k
    found = P.written(_blockwise(queries, docs, query=query, query_vec=query_vec, item=doc, vec=vec, k=deep, min_sim=None), "leaders")
    leaders = scale.top_per_key(found.drop("lowest"), "query_id", [F.col("similarity").desc(), F.col("item_id")], deep)
    leaders = leaders.select("query_id", F.col("item_id").alias("doc_id"), "similarity")
    # A shorter list of leaders holds all documents with a vector: nobody else has a similarity.
    v_range = found.groupBy("query_id").agg(F.min("lowest").alias("_vlo"), F.max("similarity").alias("_vhi"))
    last = leaders.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= deep, F.min("similarity")).alias("_vcap"))
    scores = bm25_scores(queries, docs, query=query, query_text=query_text, doc=doc, text=text).select(F.col(query).alias("query_id"), F.col(doc).alias("doc_id"), "bm25")
    scores = P.written(scores, "scores")
    t_range = scores.groupBy("query_id").agg(F.min("bm25").alias("_tlo"), F.max("bm25").alias("_thi"))

    def scaled(x: str, lo: str, hi: str) -> Column:
        span = F.col(hi) - F.col(lo)
        return F.when(F.col(x).isNull(), 0.0).when(span > 0, (F.col(x) - F.col(lo)) / span).otherwise(1.0)

    def fused(vector: str) -> Column:
        return alpha * scaled(vector, "_vlo", "_vhi") + (1 - alpha) * scaled("bm25", "_tlo", "_thi")

    ranges = queries.select(F.col(query).alias("query_id")).distinct()
    for part in (v_range, last, t_range):
        ranges = scale.null_safe_join(ranges, part, ["query_id"], "left")
    known = scores.withColumn("similarity", F.lit(None).cast("double")).unionByName(leaders.withColumn("bm25", F.lit(None).cast("double")))
    known = known.groupBy("query_id", "doc_id").agg(F.max("similarity").alias("similarity"), F.max("bm25").alias("bm25"))
    known = scale.null_safe_join(known, ranges, ["query_id"], "inner")
    # The k-th score that is reached whatever the vectors of the others say.
    sure = scale.top_per_key(known.withColumn("_s", fused("similarity")), "query_id", [F.col("_s").desc()], k)
    need = sure.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("_s")).alias("_need"))
    race = scale.null_safe_join(known, need, ["query_id"], "left")
    race = race.where(F.col("similarity").isNotNull() | F.col("_need").isNull() | (fused("_vcap") >= F.col("_need") - P.SLACK))
    asked = queries.select(F.col(query).alias("query_id"), F.col(query_vec).alias("_qv"))
    items = docs.select(F.col(doc).alias("doc_id"), F.col(vec).alias("_iv"))
    have = F.col("_qv").isNotNull() & F.col("_iv").isNotNull()
    empty = F.array().cast("array<float>")
    new = race.where(F.col("similarity").isNull()).drop("similarity").join(items, "doc_id").join(asked, "query_id")
    new = new.withColumn("similarity", F.when(have, cosine(F.coalesce("_qv", empty), F.coalesce("_iv", empty))))
    rows = race.where(F.col("similarity").isNotNull()).select("query_id", "doc_id", "similarity", "bm25", "_vlo", "_vhi", "_tlo", "_thi")
    rows = rows.unionByName(new.select(*rows.columns))
    rows = rows.withColumn("vector_part", scaled("similarity", "_vlo", "_vhi")).withColumn("keyword_part", scaled("bm25", "_tlo", "_thi"))
    rows = rows.select("query_id", "doc_id", F.round(alpha * F.col("vector_part") + (1 - alpha) * F.col("keyword_part"), 9).alias("score"), "vector_part", "keyword_part")
    out = scale.top_per_key(rows, "query_id", [F.col("score").desc(), F.col("doc_id")], k, rank="rank")
    return out if explain else out.drop("vector_part", "keyword_part")


def cascade_search(tiers: Sequence[DataFrame], *, query: str, k: int, order: Sequence[Column]) -> DataFrame:
    """Results of the first tier that answers a query at all; the tiers share their columns."""
    tagged = None
    for i, tier in enumerate(tiers):
        part = tier.withColumn("tier", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    first = tagged.groupBy(query).agg(F.min("tier").alias("tier"))
    return scale.top_per_key(tagged.join(first, [query, "tier"], "left_semi"), query, order, k, rank="rank")


def search_all(queries: DataFrame, tables: Mapping[str, tuple[DataFrame, str, str]], *, query: str, query_text: str, k: int) -> DataFrame:
    """Keyword search in several tables ``{name: (table, id, text)}``, ``k`` results per query and table."""
    out = None
    for name, (df, doc, text) in tables.items():
        part = keyword_search(queries, df, query=query, query_text=query_text, doc=doc, text=text, k=k).select(
            F.lit(name).alias("table_name"), query, F.col(doc).cast("long").alias("id"), "hits", "relevance", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def related_by_topics(docs: DataFrame, *, doc: str, topics: str, k: int = 3, ask: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """Other documents that share most of a document's topics (all, or its ``first`` ones), for the documents in ``ask`` (default: all).

    Topics come from a fixed list, so a document is fully described by its topic set:
    question sets meet document sets instead of documents, and a set only lists its
    first ``k + 1`` documents. The number of topic sets, not of documents, bounds the work.
    """
    described = docs.where(F.size(topics) > 0).select(doc, F.col(topics).alias("_set"))
    asked = described if ask is None else described.join(ask.select(doc), doc, "left_semi")
    asked = asked.withColumn("_ask", F.col("_set") if first is None else F.slice("_set", 1, first)).drop("_set")
    listed = scale.top_per_key(described, "_set", [F.col(doc)], k + 1)
    questions = asked.select("_ask").distinct().select("_ask", F.explode("_ask").alias("_topic"))
    sets = described.select(F.col("_set").alias("_other")).distinct().select("_other", F.explode("_other").alias("_topic"))
    shared = questions.join(sets, "_topic").groupBy("_ask", "_other").agg(F.count(F.lit(1)).alias("shared"))
    options = shared.join(listed.select(F.col("_set").alias("_other"), F.col(doc).alias("related_id")), "_other")
    best = scale.top_per_key(options, "_ask", [F.col("shared").desc(), F.col("related_id")], k + 1)
    found = asked.join(best.select("_ask", "related_id", "shared"), "_ask").where(F.col(doc) != F.col("related_id")).drop("_ask")
    return scale.top_per_key(found, doc, [F.col("shared").desc(), F.col("related_id")], k, rank="rank", salts=1)


def project_2d(vectors: DataFrame, *, item: str, vec: str) -> DataFrame:
    """Two principal components of the vectors, for plotting."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    dense = vectors.select(item, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(dense)
    out = model.transform(dense).withColumn("_a", vector_to_array("_p"))
    return out.select(item, F.col("_a")[0].alias("x"), F.col("_a")[1].alias("y"))
