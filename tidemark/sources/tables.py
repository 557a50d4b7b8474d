"""Table sinks and keyed maintenance on Parquet folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import scale


def typed_rows(df: DataFrame, types: Mapping[str, str], defaults: Mapping[str, Any] | None = None, required: Sequence[str] = ()) -> DataFrame:
    """Columns coerced to their declared types with defaults for missing values, and a ``_bad`` flag.

    A row is bad when a given value cannot be coerced or a required column is missing.
    """
    bad = F.lit(False)
    out = {}
    for name, kind in types.items():
        raw = F.col(name) if name in df.columns else F.lit(None).cast("string")
        value = raw.try_cast(kind)
        bad = bad | (raw.isNotNull() & value.isNull())
        if name in required:
            bad = bad | value.isNull()
        out[name] = F.coalesce(value, F.lit((defaults or {})[name]).cast(kind)) if name in (defaults or {}) else value
    return df.select(*[c.alias(n) for n, c in out.items()], bad.alias("_bad"))


def write_table(df: DataFrame, path: str, types: Mapping[str, str], *, defaults: Mapping[str, Any] | None = None, required: Sequence[str] = (),
                partition_by: Sequence[str] = (), mode: str = "append") -> DataFrame:
    """Write good rows as Parquet and return the (good, bad) counts of the batch.

    Rows are not gathered by partition value first: a value with a large share of the
    rows is written by many tasks.
    """
    rows = typed_rows(df, types, defaults, required)
    good = rows.where(~F.col("_bad")).drop("_bad")
    writer = good.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return rows.agg(F.count_if(~F.col("_bad")).alias("good"), F.count_if("_bad").alias("bad"))


def load_new(df: DataFrame, existing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of keys not yet stored, summary of keys and rows per outcome)."""
    have = existing.select(key).distinct()
    fresh = df.join(have, key, "left_anti")
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).join(have.withColumn("_old", F.lit(True)), key, "left")
    outcome = F.when(F.col("_old"), "skipped").otherwise("success")
    return fresh, per.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("keys"), F.sum("_n").alias("n_rows"))


def upsert(base: DataFrame, changes: DataFrame, key: str | Sequence[str], ts: str) -> DataFrame:
    """Latest row per key of both tables; a change wins a tie."""
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return scale.top_per_key(both, key, [F.col(ts).desc(), F.col("_new").desc()], 1).drop("_new")


def delete_keys(base: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not listed."""
    return base.join(keys, list(on), "left_anti")


def set_status(base: DataFrame, ids: DataFrame, id_col: str, status: str, *, column: str = "processing_status") -> DataFrame:
    """New status for the listed ids."""
    hit = ids.select(id_col).distinct().withColumn("_hit", F.lit(True))
    return base.join(hit, id_col, "left").withColumn(column, F.when(F.col("_hit"), F.lit(status)).otherwise(F.col(column))).drop("_hit")


def summarize_nested(df: DataFrame) -> DataFrame:
    """Flat summary: scalars stay, lists become counts, number maps their top key, other maps key counts."""
    columns: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            columns.append(F.coalesce(F.size(c), F.lit(0)).alias(f"{f.name}_count"))
        elif isinstance(f.dataType, T.MapType):
            if isinstance(f.dataType.valueType, T.NumericType):
                best = F.array_max(F.transform(F.map_entries(c), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))
                columns.append(best["k"].alias(f"{f.name}_top"))
            else:
                columns.append(F.size(c).alias(f"{f.name}_keys"))
        elif isinstance(f.dataType, T.StructType):
            columns.append(F.to_json(c).alias(f.name))
        else:
            columns.append(c.alias(f.name))
    return df.select(*columns)


def export_csv(df: DataFrame, path: str) -> None:
    """Flat summary as CSV part files with a header."""
    summarize_nested(df).write.mode("overwrite").option("header", True).csv(path)


def snapshot(tables: Mapping[str, tuple[DataFrame, Sequence[Column]]], n: int) -> DataFrame:
    """(table, JSON row) of the first ``n`` rows of every table in its stated order."""
    parts = [df.orderBy(*order).limit(n).select(F.lit(name).alias("table_name"), F.to_json(F.struct(*df.columns)).alias("record")) for name, (df, order) in tables.items()]
    return reduce(DataFrame.unionByName, parts)
