"""Entity records: JSON round trip, typed clean-up and JSON access."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def to_record(df: DataFrame, name: str = "record") -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def from_record(df: DataFrame, schema: StructType, name: str = "record") -> DataFrame:
    """Typed columns from JSON text; malformed rows give nulls."""
    return df.select(F.from_json(name, schema).alias("_r")).select("_r.*")


def typed(value: Column, kind: str) -> Column:
    """Value coerced to a field kind; what cannot be coerced is null (array elements are dropped)."""
    if kind.startswith("array<"):
        inner = kind[6:-1]
        return F.array_compact(F.transform(value, lambda x: x.try_cast(inner)))
    return value.try_cast(kind)


def sanitize(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """Coerce the named columns to the expected kinds; absent columns are added as null."""
    return df.withColumns({c: typed(F.col(c), k) if c in df.columns else F.lit(None).cast(k) for c, k in spec.items()})
