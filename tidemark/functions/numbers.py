"""Parsing, bounding and formatting of messy numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SIGNED = r"([-+]?[0-9]*\.?[0-9]+)"
WITH_UNIT = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*([KkMmBbTt]?)$"
# Unit suffixes.
SUFFIXES = {"K": 1e3, "M": 1e6, "B": 1e9, "T": 1e12}


def as_col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def safe_double(text: Column) -> Column:
    """The number if the whole text is one, else null (also for texts such as ``1d``)."""
    return F.regexp_extract(text, NUMBER, 0).try_cast("double")


def parse_number(value: str | Column) -> Column:
    """Number from text with separators, currency signs, ``%`` and K/M/B/T; 0.0 if there is none."""
    text = F.trim(F.regexp_replace(as_col(value).cast("string"), r"[,%$€£¥]", ""))
    unit = F.upper(F.regexp_extract(text, WITH_UNIT, 2))
    factor = F.lit(1.0)
    for suffix, size in SUFFIXES.items():
        factor = F.when(unit == suffix, size).otherwise(factor)
    whole = F.regexp_extract(text, WITH_UNIT, 1).try_cast("double")
    first = F.regexp_extract(text, SIGNED, 1).try_cast("double")
    return F.coalesce(whole * factor, first, F.lit(0.0))


def parse_fraction(value: str | Column) -> Column:
    """``20%`` or ``20`` to 0.2; a bare number up to 1 is kept; null if there is no number."""
    text = as_col(value).cast("string")
    percent = safe_double(F.regexp_extract(text, r"([0-9]+\.?[0-9]*)%", 1))
    plain = safe_double(F.regexp_extract(text, r"(-?[0-9]+\.?[0-9]*)", 1))
    return F.when(percent.isNotNull(), percent / 100).otherwise(F.when(plain <= 1, plain).otherwise(plain / 100))


def parse_aum_millions(value: str | Column) -> Column:
    """Assets under management in millions: million = 1, billion = 1000, bare numbers are units."""
    text = F.lower(F.regexp_replace(as_col(value).cast("string"), r"[$£€,]", ""))
    amount = safe_double(F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1))
    factor = F.when(text.contains("m"), F.lit(1.0)).when(text.contains("b"), F.lit(1000.0)).otherwise(F.lit(0.000001))
    return F.coalesce(amount * factor, F.lit(0.0))


def parse_amount(value: str | Column) -> Column:
    """Amount with an optional billion/million/thousand unit as a plain number; null if absent."""
    text = F.lower(F.regexp_replace(as_col(value).cast("string"), r"[$£€,]", ""))
    amount = safe_double(F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1))
    unit = F.regexp_extract(text, r"[0-9]\s*(b|m|k)", 1)
    factor = F.when(unit == "b", 1e9).when(unit == "m", 1e6).when(unit == "k", 1e3).otherwise(1.0)
    return amount * factor


def parse_rating10(value: str | Column) -> Column:
    """Rating on a 0-10 scale from ``7/10``, ``70%``, a 0-5, 0-10 or 0-100 number; 5.0 if unreadable."""
    text = F.trim(as_col(value).cast("string"))
    pair = r"([0-9]+(?:\.[0-9]+)?)\s*(?:/|out of)\s*([0-9]+(?:\.[0-9]+)?)"
    top = safe_double(F.regexp_extract(text, pair, 1))
    bottom = safe_double(F.regexp_extract(text, pair, 2))
    plain = safe_double(text)
    percent = safe_double(F.trim(F.regexp_replace(text, "%", ""))) / 10
    return F.coalesce(
        F.when(text.contains("%"), percent)
        .when(top.isNotNull() & (bottom != 0), top / bottom * 10)
        .when(plain <= 5.5, plain * 2)
        .when(plain > 10, plain / 10)
        .otherwise(plain),
        F.lit(5.0),
    )


def clamp(value: str | Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Bound a score to ``[low, high]``."""
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), as_col(value)))


def compact(value: Column, digits: int = 2) -> Column:
    """``1.23B`` / ``4.56M`` / ``7.89K`` style text."""
    size = F.abs(value)

    def part(divisor: float, unit: str) -> Column:
        return F.concat(F.format_number(value / divisor, digits), F.lit(unit))

    return (
        F.when(size >= 1e12, part(1e12, "T"))
        .when(size >= 1e9, part(1e9, "B"))
        .when(size >= 1e6, part(1e6, "M"))
        .when(size >= 1e3, part(1e3, "K"))
        .otherwise(F.format_number(value, digits))
    )


def fmt_currency(value: str | Column, digits: int = 2, sign: str = "$", short: bool = False) -> Column:
    """Currency text, ``N/A`` when null; ``short`` uses K/M/B/T units."""
    x = as_col(value)
    body = compact(F.abs(x), digits) if short else F.format_number(F.abs(x), digits)
    return F.when(x.isNull(), F.lit("N/A")).otherwise(
        F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.lit(sign), body))


def fmt_percent(value: str | Column, digits: int = 2, fraction: bool = False) -> Column:
    """Percent text, ``N/A`` when null; ``fraction`` multiplies by 100 first."""
    x = as_col(value)
    shown = x * 100 if fraction else x
    return F.when(x.isNull(), F.lit("N/A")).otherwise(F.concat(F.format_number(shown, digits), F.lit("%")))


def wei_to_eth(value: str | Column) -> Column:
    """Wei (text or number) to ether; read as an exact decimal before it is scaled."""
    return as_col(value).try_cast("decimal(38,0)").cast("double") / F.lit(1e18)


def token_units(value: str | Column, decimals: str | Column) -> Column:
    """Raw token amount divided by ten to the token's decimals."""
    return as_col(value).cast("double") / F.pow(F.lit(10.0), as_col(decimals).cast("double"))
