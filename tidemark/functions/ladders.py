"""Score-to-label ladders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numbers import as_col

# Fixed values: (upper bounds, labels) of the score ladders; a score below bounds[i] gets labels[i].
FIVE_LEVEL = ([20, 40, 60, 80], ["Very Low", "Low", "Moderate", "High", "Very High"])
WALLET_FIVE_LEVEL = ([20, 40, 60, 80], ["Very Low", "Low", "Medium", "High", "Very High"])
THREE_LEVEL = ([30, 70], ["Low", "Medium", "High"])
COMPONENT_LEVEL = ([3, 5, 7, 9], ["Very Low", "Low", "Medium", "High", "Very High"])
COMPLIANCE_LEVEL = ([30, 50, 70, 85], ["Low", "Partial", "Moderate", "Substantial", "High"])


def bucketize(value: str | Column, bounds: Sequence[float], labels: Sequence[str],
              missing: str | None = None) -> Column:
    """Label of the first bound the value lies below; the last label beyond all bounds."""
    x = as_col(value)
    out = F.when(x.isNull(), F.lit(missing).cast("string"))
    for bound, label in zip(bounds, labels):
        out = out.when(x < bound, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def above(value: Column, steps: Sequence[tuple[float, str]], last: str) -> Column:
    """Label of the first (descending) threshold the value exceeds."""
    out = None
    for bound, label in steps:
        out = F.when(value > bound, label) if out is None else out.when(value > bound, label)
    return out.otherwise(last)


def five_level(value: str | Column) -> Column:
    return bucketize(value, *FIVE_LEVEL, missing="Undetermined")


def wallet_level(value: str | Column) -> Column:
    return bucketize(value, *WALLET_FIVE_LEVEL)


def three_level(value: str | Column) -> Column:
    return bucketize(value, *THREE_LEVEL)


def component_level(value: str | Column) -> Column:
    return bucketize(value, *COMPONENT_LEVEL)


def compliance_level(value: str | Column) -> Column:
    return bucketize(value, *COMPLIANCE_LEVEL)
