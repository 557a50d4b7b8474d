"""Top-k, extremes, pages and bands."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import scale


def top_k(df: DataFrame, by: str, k: int, *, largest: bool = True, tie: Sequence[Column] = ()) -> DataFrame:
    """The ``k`` largest or smallest rows; each task keeps at most ``k``."""
    order = F.col(by).desc_nulls_last() if largest else F.col(by).asc_nulls_last()
    return df.orderBy(order, *tie).limit(k)


def arg_extreme(df: DataFrame, value: str, *, largest: bool = True, tie: Sequence[Column] = ()) -> DataFrame:
    """The whole row that holds the largest or smallest value."""
    return top_k(df, value, 1, largest=largest, tie=tie)


def page(df: DataFrame, *, sort: str, ascending: bool = False, limit: int = 20, offset: int = 0,
         status: Any = None, status_col: str = "status", tie: Sequence[Column] = ()) -> DataFrame:
    """One sorted page, optionally of one status. Every task keeps ``offset + limit`` rows: for pages far down see :func:`deep_page`."""
    out = df if status is None else df.where(F.col(status_col) == status)
    return out.orderBy(F.col(sort).asc() if ascending else F.col(sort).desc(), *tie).offset(offset).limit(limit)


#: Ranges for each shuffle partition, and sampled rows for each range.
RANGES_PER_PARTITION, ROWS_PER_RANGE = 4, 100


def deep_page(df: DataFrame, *, sort: str, ascending: bool = False, limit: int = 20, offset: int = 0,
              status: Any = None, status_col: str = "status", tie: Sequence[Column] = ()) -> DataFrame:
    """The rows of :func:`page` at any offset: a directory of row counts per range tells which ranges hold the page, and only those are sorted.

    The edges of the ranges are rows of a sample that is chosen by a hash, in a scalar subquery of the plan. They compare ``sort`` and then ``tie`` (plain
    columns, ascending), so a value that a third of all rows share is cut by its ties. Rows that are equal in all of them stay together. Rows come unordered
    out of several ranges and are ordered at the end, ``limit`` of them. An empty table or an offset behind the last row gives no rows.
    """
    rows = df if status is None else df.where(F.col(status_col) == status)
    first, rest = F.struct(F.col(sort).alias("v")), F.struct(*[t.alias(f"t{i}") for i, t in enumerate(tie)], F.lit(0).alias("end"))
    order = [F.col("_first").asc() if ascending else F.col("_first").desc(), F.col("_rest")]
    keyed = rows.select("*", first.alias("_first"), rest.alias("_rest"))
    levels = max(5, (RANGES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length())
    edges = (1 << levels) - 1
    share = keyed.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / (ROWS_PER_RANGE * edges))).cast("long")).scalar()
    sample = keyed.select("_first", "_rest").where(F.pmod(F.xxhash64("_first", "_rest"), share) == 0)
    # The sample has a fixed size, so one task may number it.
    numbered = sample.select(F.struct("_first", "_rest").alias("edge"), F.row_number().over(Window.orderBy(*order)).alias("n"))
    total = numbered.agg(F.max("n")).scalar()
    picked = numbered.withColumn("slot", F.floor(F.col("n") * (edges + 1) / (total + 1))).groupBy("slot").agg(F.min_by("edge", "n").alias("edge"))
    cuts = picked.where("slot > 0").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "edge"))), lambda x: x["edge"])).scalar()

    def reached(edge: Column) -> Column:
        """Whether the edge is at or before the row; structs compare null like a smallest value."""
        ahead = edge["_first"] < F.col("_first") if ascending else edge["_first"] > F.col("_first")
        return ahead | ((edge["_first"] == F.col("_first")) & (edge["_rest"] <= F.col("_rest")))

    steps = F.array(*[F.lit(1 << i) for i in reversed(range(levels))])
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size("_cuts")) & reached(F.get(F.col("_cuts"), at + step - 1)), at + step).otherwise(at))
    ranged = keyed.withColumn("_cuts", cuts).withColumn("_range", place).drop("_cuts")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_in"))
    before = F.sum("_in").over(Window.orderBy("_range")) - F.col("_in")
    holding = counts.select("_range", before.alias("_before"), "_in").where((F.col("_before") < offset + limit) & (F.col("_before") + F.col("_in") > offset))
    number = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    found = ranged.join(holding, "_range").withColumn("_number", number).where((F.col("_number") > offset) & (F.col("_number") <= offset + limit))
    return found.orderBy("_number").select(*[F.col(f"`{c}`") for c in df.columns])


def percentile_band(df: DataFrame, value: str, band: str) -> DataFrame:
    """Rows at or above the 25th (``p25``), 50th or 75th percentile by index; ``all`` keeps every row."""
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    if band not in shares:
        return df
    edge = scale.exact_percentiles(df, None, value, {"edge": shares[band]}, discrete=True)
    return df.where(F.col(value) >= edge.scalar())


def top_k_per(df: DataFrame, key: str | Sequence[str], by: str, k: int, *, largest: bool = True,
              tie: Sequence[Column] = (), rank: str | None = None) -> DataFrame:
    """The ``k`` best rows of every key."""
    order = F.col(by).desc() if largest else F.col(by).asc()
    return scale.top_per_key(df, key, [order, *tie], k, rank=rank)


def mode_per(df: DataFrame, key: str | Sequence[str], column: str) -> DataFrame:
    """Most frequent value per key with its count; ties go to the smallest value."""
    names = scale.as_keys(key)
    counts = df.where(F.col(column).isNotNull()).groupBy(*names, column).agg(F.count(F.lit(1)).alias("n"))
    return scale.top_per_key(counts, names, [F.col("n").desc(), F.col(column).asc()], 1)
