"""Selections: point lookups, dynamic conjunctions, facets, previews and feeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.symbols import norm_symbol


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def lookup(df: DataFrame, equals: Mapping[str, Any], *, order: Sequence[Column] = (), n: int | None = None) -> DataFrame:
    """Rows equal on every given column, newest or smallest first, at most ``n``."""
    out = df.where(all_of([F.col(c) == v for c, v in equals.items()]))
    out = out.orderBy(*order) if order else out
    return out if n is None else out.limit(n)


def by_symbol(df: DataFrame, symbols: Sequence[str], column: str = "symbol", fuzzy: bool = False) -> DataFrame:
    """Rows of the symbols whatever their quote or case; ``fuzzy`` also takes symbols that contain one."""
    wanted = [s.upper() for s in symbols]
    bases = sorted({s[: -len(q)] if s.endswith(q) and len(s) > len(q) else s for s in wanted for q in ("USDT", "USD")} | set(wanted))
    hit = norm_symbol(F.col(column), "base").isin(bases) | F.upper(F.col(column)).isin(wanted)
    if fuzzy:
        hit = hit | any_of([F.upper(F.col(column)).contains(b) for b in bases])
    return df.where(hit)


def where_all(df: DataFrame, *, ts: str | None = None, since: Any = None, until: Any = None,
              last_days: int | None = None, as_of: Column | None = None,
              equals: Mapping[str, Any] | None = None, contains: Mapping[str, Any] | None = None) -> DataFrame:
    """All given conditions at once; conditions left out do not filter."""
    conditions: list[Column] = []
    if since is not None:
        conditions.append(F.col(ts) >= since)
    if until is not None:
        conditions.append(F.col(ts) <= until)
    if last_days is not None:
        conditions.append(F.col(ts) >= as_of - F.expr(f"INTERVAL {int(last_days)} DAYS"))
    conditions += [F.col(c) == v for c, v in (equals or {}).items()]
    conditions += [F.array_contains(F.col(c), v) for c, v in (contains or {}).items()]
    return df.where(all_of(conditions))


def contains_any(column: str | Column, terms: Sequence[str]) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return F.arrays_overlap(col, F.array(*[F.lit(t) for t in terms]))


def contains_all(column: str | Column, terms: Sequence[str]) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return F.size(F.array_except(F.array(*[F.lit(t) for t in terms]), col)) == 0


def like_any(column: str | Column, terms: Sequence[str]) -> Column:
    """Text contains one of the terms, ignoring case."""
    col = F.col(column) if isinstance(column, str) else column
    return any_of([F.lower(col).contains(t.lower()) for t in terms])


def visible_to(df: DataFrame, user: Any, owner: str = "user_id", public: str = "is_public") -> DataFrame:
    """Own rows and public rows."""
    return df.where((F.col(owner) == user) | F.col(public))


def facet_news(df: DataFrame, *, text: str | None = None, label: str | None = None, asset: str | None = None,
               source: str | None = None, title: str = "title", body: str = "content",
               label_col: str = "sentiment_label", assets: str = "related_assets", source_col: str = "source") -> DataFrame:
    """Free text in title or body together with label, asset and source facets."""
    conditions = []
    if text:
        conditions.append(like_any(title, [text]) | like_any(body, [text]))
    if label:
        conditions.append(F.col(label_col) == label)
    if asset:
        conditions.append(F.array_contains(assets, asset))
    if source:
        conditions.append(F.col(source_col) == source)
    return df.where(all_of(conditions))


def facet_risk(df: DataFrame, *, start: Any = None, end: Any = None, text: str | None = None, ts: str = "analysis_timestamp",
               score: str = "risk_score", columns: Sequence[str] = ("symbol", "risk_category")) -> DataFrame:
    """Profiles in a date range that mention the text; error profiles (score -1) never show."""
    conditions = [F.col(score) != -1]
    if start is not None:
        conditions.append(F.col(ts) >= start)
    if end is not None:
        conditions.append(F.col(ts) <= end)
    if text:
        conditions.append(any_of([like_any(c, [text]) for c in columns]))
    return df.where(all_of(conditions))


def lookback(df: DataFrame, ts: str, days: int, as_of: Any) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``."""
    limit = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    return df.where(F.col(ts) >= limit - F.expr(f"INTERVAL {int(days)} DAYS"))


def preview(df: DataFrame, body: str, n: int = 200, name: str = "preview", dates: Sequence[str] = ()) -> DataFrame:
    """Replace a long body by its first characters and dates by ISO text."""
    short = F.when(F.length(body) > n, F.concat(F.substring(body, 1, n), F.lit("..."))).otherwise(F.col(body))
    out = df.withColumn(name, short).drop(body)
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c in dates}) if dates else out


def resolve_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]], fill: Mapping[str, Any] | None = None) -> DataFrame:
    """Give columns their canonical name: exact alias first, then one that contains an alias.

    ``fill`` adds canonical columns that nothing matched: a column name copies that column,
    anything else is a constant.
    """
    lower = {c.lower(): c for c in df.columns}
    taken: dict[str, str] = {}
    for canonical, names in aliases.items():
        found = next((lower[n.lower()] for n in names if n.lower() in lower and lower[n.lower()] not in taken.values()), None)
        if found is None:
            found = next((c for n in names for c in df.columns
                          if n.lower() in c.lower() and c not in taken.values()), None)
        if found is not None:
            taken[canonical] = found
    columns = [F.col(f"`{c}`").alias(name) for name, c in taken.items()]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in taken.values() and c not in taken]
    out = df.select(*columns, *rest)
    for name, value in (fill or {}).items():
        if name not in out.columns:
            out = out.withColumn(name, F.col(value) if isinstance(value, str) and value in out.columns else F.lit(value))
    return out


def valid_rows(df: DataFrame, *, required: Sequence[str] = (), dates: Sequence[str] = (), numeric: Sequence[str] = ()) -> DataFrame:
    """Rows with all required texts set, dates that parse and numbers that are numbers."""
    conditions = [F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") for c in required]
    conditions += [F.col(c).try_cast("timestamp").isNotNull() for c in dates]
    conditions += [F.col(c).try_cast("double").isNotNull() for c in numeric]
    return df.where(all_of(conditions))


def score_band(score: str | Column, high: float = 0.3, low: float = -0.3) -> Column:
    """positive above ``high``, negative below ``low``, else neutral."""
    x = F.col(score) if isinstance(score, str) else score
    return F.when(x > high, "positive").when(x < low, "negative").otherwise("neutral")


def recent_feed(df: DataFrame, ts: str, n: int, score: str, *, tie: Sequence[Column] = (),
                defaults: Mapping[str, Any] | None = None) -> DataFrame:
    """Newest ``n`` rows with a sentiment band and defaults for missing fields."""
    out = df.orderBy(F.col(ts).desc(), *tie).limit(n).withColumn("band", score_band(F.coalesce(F.col(score), F.lit(0.0))))
    return out.fillna(dict(defaults)) if defaults else out


def facet_docs(df: DataFrame, *, text: str | None = None, status: str | None = None, kind: str | None = None,
               title: str = "title", arrays: Sequence[str] = (), status_col: str = "processing_status",
               kind_col: str = "document_type") -> DataFrame:
    """Title or entity-array text match together with status and kind facets."""
    conditions = []
    if text:
        needle = text.lower()
        in_arrays = [F.exists(F.col(a), lambda x: F.lower(x).contains(needle)) for a in arrays]
        conditions.append(any_of([F.lower(F.col(title)).contains(needle), *in_arrays]))
    if status:
        conditions.append(F.col(status_col) == status)
    if kind:
        conditions.append(F.col(kind_col) == kind)
    return df.where(all_of(conditions))
