"""Ranked search over postings in blocks of like impact.

A posting's *impact* is its share of a score before the query's weight. Postings of a term
are filed in blocks by impact, and a directory keeps the number of rows and the highest
impact of each block. A query first scores its rarest terms, which gives a score that its
``k``-th result reaches in any case. Blocks of frequent terms whose bounds together stay
under that score cannot bring a document into the result by themselves: they are not opened, and only
the documents that other blocks leave in the race fetch their postings there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.lexicons import STOPWORDS
from tidemark.operators import terms as T
from tidemark.session import written

#: The row that carries a document's length: no token is empty.
LENGTH = ""
#: Impact blocks per doubling of the impact.
BANDS = 4
#: Scores are ordered by nine digits; bounds are compared with more room than that.
SLACK = 1e-6


def term_postings(docs: DataFrame, *, doc: str, text: str, stopwords: Sequence[str] = tuple(STOPWORDS), wanted: DataFrame | None = None) -> DataFrame:
    """(document, term, tf, len), written: texts are spread once and tokenised once, and counted where they are.

    Texts are spread by id and length, over as many tasks as their characters ask for, so that rows without an id do not meet in one task. The wanted terms are written first: Spark
    then knows how small they are, and filters terms where they are instead of shuffling all of them. A row with the term ``""`` per document carries its length also where none of the
    ``wanted`` terms (default: all) occurs; its ``tf`` is the number of rows of that id and length.
    """
    base = docs.select(doc, F.col(text).alias("_x"), F.length(text).alias("_chars")).repartition(T.text_parts(docs, text), doc, "_chars")
    base = base.select(doc, "_chars", T.tokens(F.col("_x"), stopwords).alias("_t")).select(doc, "_chars", "_t", F.size("_t").alias("len"))
    rows = scale.unnest(base, [doc, "_chars", "len"], F.concat("_t", F.array(F.lit(LENGTH))), "term")
    if wanted is not None:
        length_row = docs.sparkSession.range(1).select(F.lit(LENGTH).alias("term"))
        rows = rows.join(written(wanted.select("term").distinct().unionByName(length_row), "wanted"), "term", "left_semi")
    counts = rows.groupBy(doc, "_chars", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    return written(counts.select(doc, "term", "tf", "len"), "postings")


def bm25_impacts(index: DataFrame, doc: str, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(document, term, impact): the part of BM25 that depends on the document."""
    stats = index.where(F.col("term") == LENGTH).agg((F.sum(F.col("tf") * F.col("len")) / F.sum("tf")).alias("avg")).scalar()
    share = F.col("len") / F.col("_avg")
    impact = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * share))
    return index.where(F.col("term") != LENGTH).withColumn("_avg", stats).select(doc, "term", impact.alias("impact"))


def bm25_weights(index: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` with the weight of each term: its inverse document frequency."""
    n = index.where(F.col("term") == LENGTH).agg(F.sum("tf").alias("n")).scalar()
    df = index.where(F.col("term") != LENGTH).groupBy("term").agg(F.count(F.lit(1)).alias("_df")).withColumn("_n", n)
    return asked.join(df.select("term", F.ln(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)).alias("weight")), "term")


def directory(impacts: DataFrame) -> DataFrame:
    """(term, band, n, top) of ``impacts`` with a ``band``: rows and highest impact of each block."""
    return impacts.groupBy("term", "band").agg(F.count(F.lit(1)).alias("n"), F.max("impact").alias("top"))


def _kth(scores: DataFrame, query: str, k: int) -> DataFrame:
    """(query, least): the ``k``-th best score of queries with at least ``k`` rows."""
    best = scale.top_per_key(scores.select(query, "score"), query, [F.col("score").desc()], k)
    return best.groupBy(query).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("least")).where(F.col("_n") >= k).drop("_n")


def _sums(impacts: DataFrame, blocks: DataFrame, query: str, doc: str) -> DataFrame:
    part = F.col("weight") * F.col("impact")
    return impacts.join(blocks.select(query, "term", "band", "weight"), ["term", "band"]).groupBy(query, doc).agg(F.sum(part).alias("score"))


def plan_blocks(impacts: DataFrame, asked: DataFrame, *, query: str, doc: str, k: int) -> DataFrame:
    """(query, term, band, weight, n, top, skipped, least), written: which blocks a query opens.

    ``impacts`` carry a band, ``asked`` a weight of at least 0 per query and term. Half of the highest score a query could have, in its rarest terms, is scored first;
    the ``k`` documents that lead there are scored whole, and the lowest of these scores is ``least``. From the longest list down, blocks are skipped as long as the bounds of all that is skipped stay under ``least``.
    """
    blocks = written(directory(impacts), "directory")
    lists = blocks.groupBy("term").agg(F.sum("n").alias("_df"), F.max("top").alias("_top"))
    high = F.col("weight") * F.col("_top")
    rare = Window.partitionBy(query).orderBy("_df", "term").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(query)
    lists = asked.join(lists, "term").withColumn("_high", high).withColumn("_before", F.coalesce(F.sum("_high").over(rare), F.lit(0.0)))
    lists = lists.withColumn("_all", F.sum("_high").over(whole))
    seeds = lists.where(2 * F.col("_before") < F.col("_all")).join(blocks.select("term", "band"), "term")
    first = scale.top_per_key(_sums(impacts, seeds, query, doc), query, [F.col("score").desc()], k).select(query, doc)
    first = scale.null_safe_join(first, asked.select(query, "term", "weight"), [query], "inner")
    first = scale.null_safe_join(impacts, first, [doc, "term"], "inner").groupBy(query, doc).agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))
    least = _kth(first, query, k)
    lists = scale.null_safe_join(lists, least, [query], "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    # What is left for a list when all longer ones are skipped whole.
    longer = Window.partitionBy(query).orderBy(F.col("_df").desc(), F.col("term").desc()).rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("least") - SLACK - F.coalesce(F.sum("_high").over(longer), F.lit(0.0))
    lists = lists.withColumn("_room", room).select(query, "term", "weight", "least", "_room")
    out = lists.join(blocks, "term").withColumn("skipped", F.col("weight") * F.col("top") < F.col("_room")).drop("_room")
    return written(out, "blocks")


def banded(impacts: DataFrame, doc: str) -> DataFrame:
    """(document, term, impact, band), written: rows that share an id add up first, so that a block's bound holds for the whole document."""
    whole = impacts.groupBy(doc, "term").agg(F.sum("impact").alias("impact"))
    return written(whole.withColumn("band", scale.value_band(F.col("impact"), BANDS)), "impacts")


def best(impacts: DataFrame, asked: DataFrame, *, query: str, doc: str, k: int) -> DataFrame:
    """(query, document, score): exact sums of weight times impact for every document that can be among a query's first ``k``.

    No limit is set on candidates: where bounds rule nothing out, all postings are scored.
    """
    impacts = banded(impacts, doc)
    asked = written(asked.groupBy(query, "term").agg(F.sum("weight").alias("weight")), "weights")
    blocks = plan_blocks(impacts, asked, query=query, doc=doc, k=k)
    opened = written(_sums(impacts, blocks.where(~F.col("skipped")), query, doc), "opened")
    skipped = blocks.where("skipped").groupBy(query, "term", "weight").agg(F.max(F.col("weight") * F.col("top")).alias("_bound"), F.max("band").alias("_upto"))
    # A row per query: what skipped blocks can add at most, and the score to reach now that more is known.
    rest = skipped.groupBy(query).agg(F.sum("_bound").alias("_rest"))
    limits = scale.null_safe_join(blocks.groupBy(query).agg(F.first("least").alias("_least")), rest, [query], "left")
    limits = scale.null_safe_join(limits, _kth(opened, query, k), [query], "left")
    limits = limits.select(query, F.coalesce("_rest", F.lit(0.0)).alias("_rest"), F.greatest("_least", F.coalesce("least", F.lit(0.0))).alias("_need"))
    running = scale.null_safe_join(opened, limits, [query], "inner").where(F.col("score") + F.col("_rest") >= F.col("_need") - SLACK).select(query, doc, "score")
    wanted = scale.null_safe_join(running.select(query, doc), skipped.select(query, "term", "weight", "_upto"), [query], "inner")
    # Bounds rise with the band, so a term's skipped blocks are those up to one band.
    fetched = scale.null_safe_join(wanted, impacts, [doc, "term"], "inner").where(F.col("band") <= F.col("_upto"))
    parts = running.unionByName(fetched.select(query, doc, (F.col("weight") * F.col("impact")).alias("score")))
    return parts.groupBy(query, doc).agg(F.sum("score").alias("score"))
