"""Unions, differences and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.functions.texts import squeeze


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both tables; a column missing on one side is null there."""
    return a.unionByName(b, allowMissingColumns=True)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that ``b`` lacks."""
    return a.subtract(b)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in a stated order."""
    return scale.top_per_key(df, keys, order, 1)


def distinct_ordered(array: Column) -> Column:
    """Array without repeats, first occurrence kept."""
    return F.array_distinct(array)


def distinct_by(df: DataFrame, column: str, order: Sequence[Column]) -> DataFrame:
    """One row per text."""
    return scale.top_per_key(df, [column], order, 1)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def diff_content(current: DataFrame, previous: DataFrame, id_col: str, body: str) -> DataFrame:
    """new / modified / unchanged / deleted per id, decided by a content hash."""
    now = current.select(id_col, F.sha2(body, 256).alias("hash"))
    before = previous.select(id_col, F.sha2(body, 256).alias("old_hash"))
    status = (
        F.when(F.col("old_hash").isNull(), "new").when(F.col("hash").isNull(), "deleted")
        .when(F.col("hash") == F.col("old_hash"), "unchanged").otherwise("modified"))
    return now.join(before, id_col, "full_outer").select(id_col, status.alias("status"), "hash", "old_hash")


def article_id(url: Column, title: Column) -> Column:
    """Stable id of an article."""
    return F.md5(F.concat_ws("_", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit(""))))


def dedupe_articles(df: DataFrame, url: str, title: str, order: Sequence[Column]) -> DataFrame:
    """One row per article id."""
    return scale.top_per_key(df.withColumn("article_id", article_id(F.col(url), F.col(title))), ["article_id"], order, 1)


def dedupe_normalized(df: DataFrame, keys: Sequence[str], text: str, order: Sequence[Column]) -> DataFrame:
    """First of the rows that only differ in case and white space, per key."""
    marked = df.withColumn("_norm", F.md5(squeeze(F.lower(F.col(text)))))
    return scale.top_per_key(marked, [*keys, "_norm"], order, 1).drop("_norm")


def needs_processing(current: DataFrame, tracker: DataFrame, id_col: str, *, digest: str = "hash",
                     ok: str = "success") -> DataFrame:
    """Rows whose hash changed or whose last run did not succeed."""
    seen = tracker.select(id_col, F.col(digest).alias("_old"), F.col(ok).alias("_ok"))
    stale = F.col("_old").isNull() | (F.col("_old") != F.col(digest)) | ~F.coalesce(F.col("_ok"), F.lit(False))
    return current.join(seen, id_col, "left").where(stale).drop("_old", "_ok")
