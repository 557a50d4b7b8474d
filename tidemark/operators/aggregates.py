"""Counts, distributions, profiles, pivots and fits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.functions.ladders import above


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per named table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def counts_by(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Rows per group, most frequent first."""
    names = scale.as_keys(keys)
    return df.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), *names)


def distribution(df: DataFrame, column: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """Count and percentage of every label, over all rows or inside groups."""
    names = scale.as_keys(by)
    counts = df.groupBy(*names, column).agg(F.count(F.lit(1)).alias("n"))
    return (
        scale.with_totals(counts, names, {"_total": F.sum("n")})
        .withColumn("pct", F.col("n") / F.col("_total") * 100).drop("_total"))


def daily_stats(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Mean and count per day."""
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def resample_daily(df: DataFrame, key: str, ts: str, value: str, label: str, *, total: str | None = None, fill: Mapping[str, Any] | None = None) -> DataFrame:
    """One row per key and calendar day: mean, most frequent label, row count (or the sum of ``total``), change and 7-day mean.

    Days without rows keep a null mean and label and a zero count, unless ``fill`` names values
    for ``mean``, ``label`` or ``change`` (the first change, too); means and changes follow the filled values.
    """
    day = F.to_date(ts).alias("day")
    facts = df.groupBy(key, day).agg(F.avg(value).alias("mean"), (F.sum(total) if total else F.count(F.lit(1))).alias("n"))
    counts = df.where(F.col(label).isNotNull()).groupBy(key, day, label).agg(F.count(F.lit(1)).alias("_c"))
    modes = scale.top_per_key(counts, [key, "day"], [F.col("_c").desc(), F.col(label)], 1).drop("_c")
    spans = facts.groupBy(key).agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    calendar = spans.select(key, F.explode(F.sequence("_a", "_b")).alias("day"))
    w = Window.partitionBy(key).orderBy("day")
    given = {label if k == "label" else k: v for k, v in (fill or {}).items()}
    rows = calendar.join(facts, [key, "day"], "left").join(modes, [key, "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double" if total else "long"))
    for name in ("mean", label):
        if name in given:
            rows = rows.withColumn(name, F.coalesce(name, F.lit(given[name])))
    change = F.col("mean") - F.lag("mean").over(w)
    return (
        rows.withColumn("change", F.coalesce(change, F.lit(given["change"])) if "change" in given else change)
        .withColumn("mean_7d", F.avg("mean").over(w.rowsBetween(-6, 0))))


def profile(df: DataFrame, value: str, by: str | Sequence[str] | None = None, *, high: float = 70, low: float = 30) -> DataFrame:
    """Mean, exact median, minimum, maximum and high/low counts, over all rows or per group."""
    names = scale.as_keys(by)
    stats = df.groupBy(*names).agg(
        F.avg(value).alias("mean"), F.min(value).alias("minimum"), F.max(value).alias("maximum"),
        F.count_if(F.col(value) > high).alias("n_high"), F.count_if(F.col(value) < low).alias("n_low"),
        F.count(value).alias("n"))
    middle = scale.exact_percentiles(df, names, value, {"median": 0.5})
    return stats.join(middle, names) if names else stats.withColumn("median", middle.scalar())


def group_mean_extremes(df: DataFrame, by: str, value: str) -> DataFrame:
    """Best and worst group by mean."""
    means = df.groupBy(by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return means.agg(
        F.max_by(by, F.struct("mean", by)).alias("best"), F.max("mean").alias("best_mean"),
        F.min_by(by, F.struct("mean", by)).alias("worst"), F.min("mean").alias("worst_mean"))


def label_pivot_daily(df: DataFrame, ts: str, label: str, labels: Sequence[str], last: int | None = 7) -> DataFrame:
    """Per-day counts of each label and in total, for the last dates with data."""
    days = df.groupBy(F.to_date(ts).alias("day")).agg(
        *[F.count_if(F.col(label) == x).alias(x.lower()) for x in labels], F.count(F.lit(1)).alias("total"))
    return days if last is None else days.orderBy(F.col("day").desc()).limit(last)


def pivot_series(df: DataFrame, ts: str, key: str, value: str, keys: Sequence[Any]) -> DataFrame:
    """One row per time, one column per key."""
    return df.groupBy(ts).pivot(key, list(keys)).agg(F.max_by(value, value))


def kpis(market: DataFrame, news: DataFrame, *, symbol: str = "symbol", cap: str = "market_cap",
         change: str = "price_change_24h", score: str = "sentiment_score") -> DataFrame:
    """Total market cap (largest per symbol), asset count, mean 24 h change and mean sentiment in percent."""
    per_symbol = market.groupBy(symbol).agg(F.max(cap).alias("_cap"), F.sum(change).alias("_change"), F.count(change).alias("_n"))
    total = per_symbol.agg(
        F.sum("_cap").alias("total_cap"), F.count(F.lit(1)).alias("assets"), (F.sum("_change") / F.sum("_n")).alias("mean_change"))
    mood = news.agg((F.avg(score) * 100).alias("sentiment_pct"))
    return total.withColumn("sentiment_pct", mood.scalar()).withColumn("trend", F.when(F.col("mean_change") >= 0, "up").otherwise("down"))


def share_of_total(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's largest value and its share of the sum in percent."""
    best = df.groupBy(key).agg(F.max(value).alias("amount"))
    return (scale.with_totals(best, None, {"_total": F.sum("amount")})
            .withColumn("share", F.round(F.col("amount") / F.col("_total") * 100, 2)).drop("_total"))


def explode_counts(df: DataFrame, array: str, k: int | None = 10) -> DataFrame:
    """Frequency of array elements, the ``k`` most frequent."""
    counts = df.select(F.explode(array).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return counts if k is None else counts.orderBy(F.col("n").desc(), "item").limit(k)


def distinct_stats(df: DataFrame, columns: Sequence[str], *, by: str | Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct values per column."""
    count = F.approx_count_distinct if approx else F.count_distinct
    return df.groupBy(*scale.as_keys(by)).agg(*[count(c).alias(f"n_{c}") for c in columns])


def global_stats(df: DataFrame, sums: Sequence[str], means: Sequence[str], split: Sequence[str] = ()) -> DataFrame:
    """Sums, means and each split column's percentage of the split columns' total."""
    total = reduce(lambda a, b: a + b, [F.sum(c) for c in split]) if split else None
    return df.agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in sums], *[F.avg(c).alias(f"avg_{c}") for c in means],
        *[(F.sum(c) / total * 100).alias(f"pct_{c}") for c in split])


def weighted_mean(df: DataFrame, value: str, weight: str, by: str | Sequence[str] | None = None, name: str = "weighted_mean") -> DataFrame:
    """Mean weighted by a column; the plain mean where the weights do not sum above zero."""
    total = F.sum(weight)
    return df.groupBy(*scale.as_keys(by)).agg(
        F.when(total > 0, F.sum(F.col(value) * F.col(weight)) / total).otherwise(F.avg(value)).alias(name))


def correlation_text(r: Column) -> Column:
    """Words for the size and sign of a correlation."""
    size = above(F.abs(r), [(0.7, "strong"), (0.4, "moderate"), (0.2, "weak")], "negligible")
    return F.concat(size, F.when(r < 0, F.lit(" negative")).otherwise(F.lit(" positive")))


def correlate(df: DataFrame, x: str, y: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation with a description; 0 when a side does not vary."""
    r = F.corr(x, y)
    safe = F.when(r.isNull() | F.isnan(r), F.lit(0.0)).otherwise(r)
    return df.groupBy(*scale.as_keys(by)).agg(safe.alias("correlation"), F.count(F.lit(1)).alias("n")).withColumn(
        "strength", correlation_text(F.col("correlation")))


def linear_fit(df: DataFrame, x: str, y: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """Least-squares line."""
    return df.groupBy(*scale.as_keys(by)).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def collect_distinct(df: DataFrame, by: str | Sequence[str], column: str) -> DataFrame:
    """Sorted distinct values per group; rows are made distinct before they meet."""
    names = scale.as_keys(by)
    return df.select(*names, column).distinct().groupBy(*names).agg(F.array_sort(F.collect_list(column)).alias("values"))


def summary_extremes(df: DataFrame, key: str, score: str) -> DataFrame:
    """Requested and scored assets, mean score, riskiest and safest asset."""
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count(score).alias("n_scored"), F.round(F.avg(score), 2).alias("mean_score"),
        F.max_by(key, F.when(F.col(score).isNotNull(), F.struct(score, key))).alias("highest"), F.max(score).alias("highest_score"),
        F.min_by(key, F.when(F.col(score).isNotNull(), F.struct(score, key))).alias("lowest"), F.min(score).alias("lowest_score"))


def prevalence(df: DataFrame, id_col: str, array: str) -> DataFrame:
    """Share of rows that carry each array element, with a severity."""
    items = df.select(id_col, F.explode(F.array_distinct(array)).alias("factor")).groupBy("factor").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_rows")).scalar()
    return (items.withColumn("prevalence", F.col("n") / total * 100)
            .withColumn("severity", above(F.col("prevalence"), [(70, "High"), (30, "Medium")], "Low")))


def type_distribution(df: DataFrame, kind: str, balance: str) -> DataFrame:
    """Count, balance and balance share per type."""
    groups = df.groupBy(F.coalesce(F.col(kind), F.lit("Unknown")).alias("type")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(balance).alias("balance"))
    out = scale.with_totals(groups, None, {"_total": F.sum("balance")})
    share = F.when(F.col("_total") > 0, F.col("balance") / F.col("_total") * 100).otherwise(0.0)
    return out.withColumn("percentage", share).drop("_total")


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Counts in equal-width bins from the smallest to the largest value; empty bins show zero."""
    edges = df.agg(F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).alias("e"))
    raw = F.floor((F.col(value) - F.col("_e.lo")) / (F.col("_e.hi") - F.col("_e.lo")) * bins)
    ix = F.when(F.col("_e.hi") == F.col("_e.lo"), F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1))).cast("int")
    counts = df.where(F.col(value).isNotNull()).withColumn("_e", edges.scalar()).groupBy(ix.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = edges.select("e", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    return frame.join(counts, "bin", "left").select(
        "bin", (F.col("e.lo") + F.col("bin") * width).alias("bin_start"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def category_counts(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Counts in a fixed category order; categories without rows show zero."""
    labels = df.agg(F.count(F.lit(1)).alias("_")).select(F.posexplode(F.array(*[F.lit(x) for x in order])).alias("position", "category"))
    counts = df.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return labels.join(counts, "category", "left").select("position", "category", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
