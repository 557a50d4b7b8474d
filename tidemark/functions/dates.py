"""Dates and timestamps in many notations."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numbers import as_col

# Date notations in the order in which they are tried.
DATE_FORMATS = [
    "yyyy-M-d",
    "yyyy-M-d H:mm:ss",
    "yyyy/M/d",
    "M/d/yyyy",
    "d/M/yyyy",
    "MMM d, yyyy",
    "d MMM yyyy",
    "d-M-yyyy",
    "d.M.yyyy",
    "M-d-yyyy",
    "yyyyMMdd",
]


SHAPES = {"yyyy": "[0-9]{4}", "MMMM": "[A-Za-z]+", "MMM": "[A-Za-z]{3}", "MM": "[0-9]{2}", "M": "[0-9]{1,2}", "dd": "[0-9]{2}", "d": "[0-9]{1,2}",
          "HH": "[0-9]{2}", "H": "[0-9]{1,2}", "mm": "[0-9]{2}", "ss": "[0-9]{2}", ".": "[.]"}


def shape_of(fmt: str) -> str:
    """Regular expression of the texts a notation can match."""
    return "^" + re.sub(r"yyyy|M+|d+|H+|mm|ss|[.]", lambda m: SHAPES[m.group(0)], fmt) + "$"


def try_parse(text: Column, fmt: str) -> Column:
    """Timestamp in one notation, else null. The cheap shape test comes first: a failed parse costs an exception."""
    return F.when(text.rlike(shape_of(fmt)), F.try_to_timestamp(text, F.lit(fmt)))


def parse_date_any(value: str | Column, formats: Sequence[str] = tuple(DATE_FORMATS)) -> Column:
    """First notation that fits; a text that only names a year becomes 1 January; else null."""
    text = F.trim(F.regexp_replace(as_col(value).cast("string"), "[\"']", ""))
    tries = [try_parse(text, f) for f in formats]
    year = F.regexp_extract(text, r"\b((?:19|20)[0-9]{2})\b", 1)
    only_year = F.when(year != "", F.try_to_timestamp(F.concat(year, F.lit("-01-01")), F.lit("yyyy-MM-dd")))
    return F.coalesce(*tries, only_year)


def epoch_auto(value: str | Column) -> Column:
    """Epoch number to timestamp; above 10^12 it counts milliseconds, else seconds."""
    x = as_col(value).try_cast("long")
    return F.when(x > F.lit(1000000000000), F.timestamp_millis(x)).otherwise(F.timestamp_seconds(x))


def to_rfc3339(value: str | Column) -> Column:
    """Timestamp as ``yyyy-MM-ddTHH:mm:ssZ`` text."""
    return F.date_format(as_col(value), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days of 24 hours from ``earlier`` to ``later``."""
    return F.floor((later.cast("double") - earlier.cast("double")) / 86400).cast("long")
