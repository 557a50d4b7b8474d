"""Time-series operators over rows keyed by ``key`` and ordered by ``ts``.

A series that was first reduced to one row per key and calendar step (``ohlc_bars``)
is bounded by the calendar, so one window per key holds it. For raw rows of a key
of any size pass ``split`` (rows per block): see :func:`tidemark.scale.over_rows`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.functions.ladders import above
from tidemark.operators.joins import side_by_side


def _frame(w: Window, n: int):
    return w.rowsBetween(-(n - 1), 0)


def _full(w: Window, n: int, value: Column, result: Column, min_periods: int | None = None) -> Column:
    """The result once the frame holds enough values, null before."""
    need = n if min_periods is None else min_periods
    return F.when(F.count(value).over(_frame(w, n)) >= need, result)


def latest_per_key(df: DataFrame, key: str | Sequence[str], ts: str, *, tie: Sequence[Column] = ()) -> DataFrame:
    """Newest row of every key."""
    return scale.top_per_key(df, key, [F.col(ts).desc(), *tie], 1)


def last_n_per_key(df: DataFrame, key: str | Sequence[str], ts: str, n: int, *, order: str = "desc", tie: Sequence[Column] = ()) -> DataFrame:
    """Newest (or with ``order="asc"`` oldest) ``n`` rows of every key."""
    first = F.col(ts).desc() if order == "desc" else F.col(ts).asc()
    return scale.top_per_key(df, key, [first, *tie], n)


def sma(df: DataFrame, key: str, ts: str, val: str, n: int, *, min_periods: int | None = None, out: str | None = None,
        split: int | None = None) -> DataFrame:
    """Simple moving average; null until ``min_periods`` (default ``n``) values are there."""
    name = out or f"sma_{n}"
    return scale.over_rows(df, key, ts, lambda w: {name: _full(w, n, F.col(val), F.avg(val).over(_frame(w, n)), min_periods)},
                           back=n - 1, split=split)


def rolling_std(df: DataFrame, key: str, ts: str, val: str, n: int, *, out: str | None = None, split: int | None = None) -> DataFrame:
    """Sample standard deviation of the last ``n`` rows."""
    name = out or f"std_{n}"
    return scale.over_rows(df, key, ts, lambda w: {name: _full(w, n, F.col(val), F.stddev_samp(val).over(_frame(w, n)))},
                           back=n - 1, split=split)


#: Rows of a series that are smoothed at once.
BLOCK = 65_536


def _part(x: np.ndarray, span: int) -> np.ndarray:
    """y = a*x + (1-a)*y_prev from the first value on; rows without a value keep the average, which weighs less with every such row."""
    return pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy()


def _entered(before: float, gap: int, first: float, span: int) -> float:
    """The average at a value `first` that follows the average `before` by `gap` rows."""
    a = 2.0 / (span + 1)
    weight = (1 - a) ** gap
    return (weight * before + a * first) / (weight + a)


def ewma(df: DataFrame, key: str, ts: str, val: str, spans: Mapping[str, int], *, split: int = BLOCK, tie: Sequence[Column] = ()) -> DataFrame:
    """Exponential averages y = a*x + (1-a)*y_prev with a = 2/(span+1), starting at the first value.

    ``spans`` maps output columns to spans. A key is cut into blocks of ``split`` rows. What a block does to the average it starts with is
    affine, y_end = scale * y_first + offset, so one pass finds both numbers for every block, composing them in order gives each block its
    start, and a second pass smooths the blocks from there. The result is that of the whole series for every ``split``, and no task holds more than a block.
    """
    return _averages(_in_blocks(df, key, ts, split, tie), key, val, spans, split).drop(*INDEX)


INDEX = ["_ix", "_n", "_block"]


def _in_blocks(df: DataFrame, key: str, ts: str, split: int, tie: Sequence[Column]) -> DataFrame:
    """Rows with their position in the key, the key's number of rows, and their block of ``split`` rows."""
    return scale.row_index(df, key, ts, tie=tie, name="_ix", total="_n").withColumn("_block", F.floor(F.col("_ix") / max(1, split)).cast("long"))


def _averages(indexed: DataFrame, key: str, val: str, spans: Mapping[str, int], split: int) -> DataFrame:
    """:func:`ewma` over rows that have an index already."""
    size, names = max(1, split), list(spans)
    schema = indexed.select("*", *[F.lit(None).cast("double").alias(c) for c in names]).schema
    kind = indexed.schema[key].dataType.simpleString()
    numbers = ", ".join(f"_scale_{i} double, _offset_{i} double" for i in range(len(names)))

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_ix")
        x = pdf[val].astype("float64").to_numpy()
        there = np.flatnonzero(~np.isnan(x))
        out: dict[str, list] = {"_key": [pdf[key].iloc[0]], "_block": [pdf["_block"].iloc[0]], "_rows": [len(x)], "_first": [None], "_last": [None], "_value": [None]}
        if len(there):
            out |= {"_first": [there[0]], "_last": [there[-1]], "_value": [x[there[0]]]}
            offsets, scales = x[there[0] :].copy(), np.where(np.isnan(x), np.nan, 0.0)[there[0] :]
            offsets[0], scales[0] = 0.0, 1.0
        for i, span in enumerate(spans.values()):
            out[f"_scale_{i}"] = [_part(scales, span)[-1] if len(there) else None]
            out[f"_offset_{i}"] = [_part(offsets, span)[-1] if len(there) else None]
        return pd.DataFrame(out)

    # A series of one block, and the last block of any, start nothing.
    parts = indexed.where((F.col("_block") + 1) * size < F.col("_n")).select(key, val, "_ix", "_block").groupBy(key, "_block").applyInPandas(
        summary, f"_key {kind}, _block long, _rows long, _first long, _last long, _value double, {numbers}")

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, gap, state = [], 0, None
        for part in pdf.sort_values("_block").to_dict("records"):
            if pd.isna(part["_first"]):
                gap += part["_rows"]
            else:
                begin = [part["_value"] if state is None else _entered(y, gap + part["_first"] + 1, part["_value"], span) for y, span in zip(state or names, spans.values())]
                state = [part[f"_scale_{i}"] * y + part[f"_offset_{i}"] for i, y in enumerate(begin)]
                gap = part["_rows"] - 1 - part["_last"]
            rows.append([part["_key"], part["_block"] + 1, gap, *(state or [None] * len(names))])
        return pd.DataFrame(rows, columns=["_key", "_block", "_gap", *[f"_start_{i}" for i in range(len(names))]]).astype({f"_start_{i}": "float64" for i in range(len(names))})

    starts = parts.groupBy("_key").applyInPandas(compose, f"_key {kind}, _block long, _gap long, " + ", ".join(f"_start_{i} double" for i in range(len(names))))

    def smooth(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_ix")
        x = pdf[val].astype("float64").to_numpy()
        there = np.flatnonzero(~np.isnan(x))
        gap = int(start["_gap"].iloc[0]) if len(start) else 0
        for i, (name, span) in enumerate(spans.items()):
            before = float(start[f"_start_{i}"].iloc[0]) if len(start) else np.nan
            y, own = np.full(len(x), before), x.copy()
            if len(there):
                if not np.isnan(before):
                    own[there[0]] = _entered(before, gap + there[0] + 1, x[there[0]], span)
                y[there[0] :] = _part(own[there[0] :], span)
            pdf[name] = y
        return pdf[[f.name for f in schema]]

    return indexed.groupBy(key, "_block").cogroup(starts.groupBy("_key", "_block")).applyInPandas(smooth, schema)


def macd(df: DataFrame, key: str, ts: str, val: str, fast: int = 12, slow: int = 26, signal: int = 9, *, split: int = BLOCK, tie: Sequence[Column] = ()) -> DataFrame:
    """MACD line, signal line and histogram: two averages of the series, and the average of their difference."""
    both = _averages(_in_blocks(df, key, ts, split, tie), key, val, {"_fast": fast, "_slow": slow}, split)
    line = both.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return _averages(line, key, "macd", {"macd_signal": signal}, split).withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop(*INDEX)


def rsi(df: DataFrame, key: str, ts: str, val: str, n: int = 14, *, eps: float = 1e-5, split: int | None = None) -> DataFrame:
    """Relative strength index on simple means of gains and losses; a zero mean loss counts as ``eps``."""
    moved = scale.over_rows(df, key, ts, lambda w: {"_d": F.col(val) - F.lag(val).over(w)}, back=1, split=split)
    gain = F.when(F.col("_d") > 0, F.col("_d")).otherwise(0.0)
    loss = F.when(F.col("_d") < 0, -F.col("_d")).otherwise(0.0)
    sides = moved.withColumn("_g", gain).withColumn("_l", loss)

    def index(w):
        g, loss_mean = F.avg("_g").over(_frame(w, n)), F.avg("_l").over(_frame(w, n))
        safe = F.when(loss_mean == 0, F.lit(eps)).otherwise(loss_mean)
        return {f"rsi_{n}": _full(w, n, F.lit(1), 100 - 100 / (1 + g / safe))}

    return scale.over_rows(sides, key, ts, index, back=n - 1, split=split).drop("_d", "_g", "_l")


def bollinger(df: DataFrame, key: str, ts: str, val: str, n: int = 20, k: float = 2.0, *, split: int | None = None) -> DataFrame:
    """Middle, upper and lower band, relative width and position of the value inside the band."""
    def stats(w):
        return {"bb_middle": _full(w, n, F.col(val), F.avg(val).over(_frame(w, n))),
                "_s": _full(w, n, F.col(val), F.stddev_samp(val).over(_frame(w, n)))}

    out = scale.over_rows(df, key, ts, stats, back=n - 1, split=split)
    out = out.withColumn("bb_upper", F.col("bb_middle") + F.col("_s") * k).withColumn("bb_lower", F.col("bb_middle") - F.col("_s") * k)
    span = F.col("bb_upper") - F.col("bb_lower")
    return (out.withColumn("bb_width", F.when(F.col("bb_middle") != 0, span / F.col("bb_middle")))
            .withColumn("bb_position", F.when(span != 0, (F.col(val) - F.col("bb_lower")) / span)).drop("_s"))


def pct_change(df: DataFrame, key: str, ts: str, val: str, k: int = 1, *, out: str = "pct_change", split: int | None = None) -> DataFrame:
    """Relative change over ``k`` rows."""
    def change(w):
        past = F.lag(val, k).over(w)
        return {out: F.when(past != 0, F.col(val) / past - 1)}
    return scale.over_rows(df, key, ts, change, back=k, split=split)


def momentum(df: DataFrame, key: str, ts: str, val: str, k: int, *, split: int | None = None) -> DataFrame:
    """Difference over ``k`` rows and its change (acceleration)."""
    out = scale.over_rows(df, key, ts, lambda w: {f"momentum_{k}": F.col(val) - F.lag(val, k).over(w)}, back=k, split=split)
    return scale.over_rows(out, key, ts, lambda w: {f"acceleration_{k}": F.col(f"momentum_{k}") - F.lag(f"momentum_{k}").over(w)},
                           back=1, split=split)


def price_to_ma(df: DataFrame, key: str, ts: str, val: str, n: int, *, split: int | None = None) -> DataFrame:
    """Value relative to its moving average."""
    out = sma(df, key, ts, val, n, out="_ma", split=split)
    return out.withColumn(f"price_to_ma_{n}", F.when(F.col("_ma") != 0, F.col(val) / F.col("_ma"))).drop("_ma")


def with_lags(df: DataFrame, key: str, ts: str, val: str, ks: Sequence[int], *, split: int | None = None) -> DataFrame:
    """Values of earlier rows."""
    return scale.over_rows(df, key, ts, lambda w: {f"lag_{k}": F.lag(val, k).over(w) for k in ks}, back=max(ks), split=split)


def with_lead(df: DataFrame, key: str, ts: str, val: str, ks: Sequence[int] = (1,), *, split: int | None = None) -> DataFrame:
    """Values of later rows (training targets)."""
    return scale.over_rows(df, key, ts, lambda w: {f"lead_{k}": F.lead(val, k).over(w) for k in ks}, back=0, ahead=max(ks), split=split)


def fill(df: DataFrame, key: str, ts: str, columns: Sequence[str], how: str = "ffill", *, then_zero: bool = False, grain: str | None = None) -> DataFrame:
    """Replace nulls by the last (``ffill``) or next (``bfill``) value of the key, then optionally by 0."""
    out = scale.carry_forward(df, key, ts, {f"_f_{c}": c for c in columns}, grain=grain, forward=how == "ffill")
    for c in columns:
        out = out.withColumn(c, F.col(f"_f_{c}")).drop(f"_f_{c}")
    return out.fillna(0, subset=list(columns)) if then_zero else out


def drawdown(df: DataFrame, key: str, ts: str, val: str, *, include_start: bool = False, grain: str | None = None) -> DataFrame:
    """Cumulative return, its running maximum and the drawdown from it.

    By default the running maximum starts with the second value (the first return);
    ``include_start`` also counts the first price.
    """
    first = df.groupBy(key).agg(F.min_by(val, ts).alias("_p0"), F.min(ts).alias("_t0"))
    out = scale.null_safe_join(df, first, [key]).withColumn("cumulative", F.col(val) / F.col("_p0"))
    shown = F.col("cumulative") if include_start else F.when(F.col(ts) > F.col("_t0"), F.col("cumulative"))
    out = scale.running_extreme(out.withColumn("_c", shown), key, ts, "_c", "running_max", grain=grain)
    return out.withColumn("drawdown", F.when(F.col("running_max") != 0, F.col("_c") / F.col("running_max") - 1)).drop("_c", "_p0", "_t0")


def max_drawdown(df: DataFrame, key: str, ts: str, val: str, *, include_start: bool = False) -> DataFrame:
    """Deepest drawdown per key."""
    return drawdown(df, key, ts, val, include_start=include_start).groupBy(key).agg(F.min("drawdown").alias("max_drawdown"))


def volatility(df: DataFrame, key: str, ts: str, val: str, rows: int = 90) -> DataFrame:
    """Daily, annual (times the root of 252), 7-row and 30-row volatility and the extreme days, in percent, of the last ``rows`` rows."""
    recent = scale.top_per_key(df.select(key, ts, val), key, [F.col(ts).desc()], rows, rank="_age")
    returns = pct_change(recent, key, ts, val, out="_r")
    daily = F.stddev_samp("_r")
    return returns.groupBy(key).agg(
        (daily * 100).alias("daily_volatility"), (daily * F.sqrt(F.lit(252.0)) * 100).alias("annual_volatility"),
        (F.stddev_samp(F.when(F.col("_age") <= 7, F.col("_r"))) * 100).alias("volatility_7"),
        (F.stddev_samp(F.when(F.col("_age") <= 30, F.col("_r"))) * 100).alias("volatility_30"),
        (F.max("_r") * 100).alias("best_day"), (F.min("_r") * 100).alias("worst_day"), F.count("_r").alias("n_returns"))


def price_stats(df: DataFrame, key: str, ts: str, val: str, *, split: int | None = None) -> DataFrame:
    """First and last value, change, extremes, mean and population volatility (percent) of the returns."""
    stats = df.groupBy(key).agg(
        F.min_by(val, ts).alias("start_price"), F.max_by(val, ts).alias("last_price"), F.max(val).alias("highest"),
        F.min(val).alias("lowest"), F.avg(val).alias("average"), F.count(val).alias("n"))
    moves = pct_change(df.select(key, ts, val), key, ts, val, out="_r", split=split).groupBy(key).agg((F.stddev_pop("_r") * 100).alias("volatility"))
    change = F.when(F.col("start_price") != 0, (F.col("last_price") / F.col("start_price") - 1) * 100)
    return stats.join(moves, key).withColumn("change_pct", change)


def period_performance(df: DataFrame, key: str, ts: str, val: str, as_of: Column) -> DataFrame:
    """Change in percent since the first row on or after 1, 3, 6, 12 months ago and the start of the year."""
    starts = {"1m": as_of - F.expr("INTERVAL 30 DAYS"), "3m": as_of - F.expr("INTERVAL 90 DAYS"), "6m": as_of - F.expr("INTERVAL 180 DAYS"),
              "1y": as_of - F.expr("INTERVAL 365 DAYS"), "ytd": F.date_trunc("year", as_of)}
    when = F.col(ts).cast("timestamp")
    wide = df.groupBy(key).agg(
        F.max_by(val, ts).alias("_last"),
        *[F.min_by(F.when(when >= start, F.col(val)), F.when(when >= start, F.col(ts))).alias(f"_{p}") for p, start in starts.items()])
    rows = F.array(*[F.struct(F.lit(p).alias("period"), F.col(f"_{p}").alias("start_price")) for p in starts])
    return (wide.select(key, F.col("_last").alias("last_price"), F.explode(rows).alias("_p"))
            .select(key, "_p.period", "_p.start_price", "last_price")
            .withColumn("change_pct", F.when(F.col("start_price") != 0, (F.col("last_price") / F.col("start_price") - 1) * 100)))


def high_low_drawdown(df: DataFrame, key: str, ts: str, val: str, min_rows: int = 30) -> DataFrame:
    """All-time high and low, when they happened, and the current distance from the high in percent."""
    out = df.groupBy(key).agg(
        F.max(val).alias("all_time_high"), F.min(val).alias("all_time_low"), F.max_by(val, ts).alias("last_price"),
        F.min(F.struct((-F.col(val)).alias("v"), F.col(ts).alias("t")))["t"].alias("high_at"),
        F.min(F.struct(F.col(val).alias("v"), F.col(ts).alias("t")))["t"].alias("low_at"), F.count(val).alias("n"))
    return out.where(F.col("n") >= min_rows).withColumn(
        "current_drawdown_pct", (F.col("last_price") / F.col("all_time_high") - 1) * 100)


def pair_correlation(df: DataFrame, key: str, ts: str, val: str, keys: Sequence[Any], min_common: int = 30) -> DataFrame:
    """Correlation of every pair of the named keys over common times, with a High (> 0.8) / Low (< 0.2) class.

    One pass: keys are lined up per time and all pairs are aggregated together.
    """
    wide = side_by_side(df, key, ts, val, keys)
    pairs = [(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys))]
    both = {p: F.col(f"k{p[0]}").isNotNull() & F.col(f"k{p[1]}").isNotNull() for p in pairs}
    row = wide.agg(*[F.corr(f"k{i}", f"k{j}").alias(f"r_{i}_{j}") for i, j in pairs],
                   *[F.count_if(both[p]).alias(f"n_{p[0]}_{p[1]}") for p in pairs])
    items = F.array(*[F.struct(F.lit(keys[i]).alias("key_a"), F.lit(keys[j]).alias("key_b"), F.col(f"r_{i}_{j}").alias("correlation"),
                               F.col(f"n_{i}_{j}").alias("n_common")) for i, j in pairs])
    out = row.select(F.explode(items).alias("_p")).select("_p.*").where(F.col("n_common") >= min_common)
    return out.withColumn("level", F.when(F.col("correlation") > 0.8, "High").when(F.col("correlation") < 0.2, "Low").otherwise("Medium"))


def rebase(df: DataFrame, key: str, ts: str, val: str, points: int = 30) -> DataFrame:
    """Change in percent against the first value, thinned to about ``points`` rows per key."""
    first = df.groupBy(key).agg(F.min_by(val, ts).alias("_p0"), F.count(F.lit(1)).alias("_n"))
    indexed = scale.row_index(df.select(key, ts, val), key, ts, name="_ix")
    indexed = scale.null_safe_join(indexed, first, [key])
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / points))
    return (indexed.where(F.col("_ix") % step == 0)
            .select(key, ts, ((F.col(val) / F.col("_p0") - 1) * 100).alias("change_pct")))


def top_performers(df: DataFrame, key: str, ts: str, val: str, k: int = 5) -> DataFrame:
    """Keys with the largest change from first to last value in either direction."""
    moves = df.groupBy(key).agg(F.min_by(val, ts).alias("first_value"), F.max_by(val, ts).alias("last_value"))
    return moves.withColumn("change", F.col("last_value") - F.col("first_value")).orderBy(F.abs("change").desc(), key).limit(k)


def half_trend(df: DataFrame, key: str, ts: str, val: str, eps: float = 0.1, *, tie: Sequence[Column] = (), grain: str | None = None) -> DataFrame:
    """Mean of the later half minus mean of the earlier half, with a label."""
    ix = scale.row_index(df, key, ts, tie=tie, grain=grain, name="_ix", total="_n")
    half = F.floor(F.col("_n") / 2)
    out = ix.groupBy(key).agg(
        F.avg(F.when(F.col("_ix") < half, F.col(val))).alias("first_half"), F.avg(F.when(F.col("_ix") >= half, F.col(val))).alias("second_half"))
    out = out.withColumn("trend", F.coalesce(F.col("second_half") - F.col("first_half"), F.lit(0.0)))
    return out.withColumn("label", F.when(F.col("trend") > eps, "improving").when(F.col("trend") < -eps, "declining").otherwise("stable"))


def recent_vs_previous(df: DataFrame, ts: str, val: str, days: int = 7, eps: float = 0.05) -> DataFrame:
    """Mean of the last ``days`` dates with data against the ``days`` before."""
    daily = df.groupBy(F.to_date(ts).alias("day")).agg(F.avg(val).alias("mean"))
    last = daily.orderBy(F.col("day").desc()).limit(2 * days).withColumn(
        "_rank", F.row_number().over(Window.orderBy(F.col("day").desc())))
    out = last.agg(F.avg(F.when(F.col("_rank") <= days, F.col("mean"))).alias("recent"),
                   F.avg(F.when(F.col("_rank") > days, F.col("mean"))).alias("previous"))
    out = out.withColumn("change", F.col("recent") - F.col("previous"))
    return out.withColumn("label", F.when(F.col("change") > eps, "improving").when(F.col("change") < -eps, "declining").otherwise("stable"))


def direction_changes(df: DataFrame, key: str, ts: str, val: str, *, tie: Sequence[Column] = (), split: int | None = None) -> DataFrame:
    """How often the sign of the value flips along the series (zero counts as down)."""
    up = df.select(key, ts, *[c for c in df.columns if c not in (key, ts)]).withColumn("_up", F.col(val) > 0)
    moved = scale.over_rows(up, key, ts, lambda w: {"_was": F.lag("_up").over(w)}, back=1, split=split, tie=tie)
    return moved.groupBy(key).agg(F.count_if(F.col("_was").isNotNull() & (F.col("_was") != F.col("_up"))).alias("direction_changes"),
                                  F.count(F.lit(1)).alias("n"))


def gaps(df: DataFrame, key: str, ts: str, min_days: int = 7) -> DataFrame:
    """Stretches of more than ``min_days`` days without rows, on the dates that have rows."""
    days = df.groupBy(key, F.to_date(ts).alias("gap_end")).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    w = Window.partitionBy(key).orderBy("gap_end")
    out = days.withColumn("gap_start", F.lag("gap_end").over(w)).withColumn("gap_days", F.datediff("gap_end", "gap_start").cast("long"))
    return out.where(F.col("gap_days") > min_days).select(key, "gap_start", "gap_end", "gap_days")


def gap_stats(df: DataFrame, key: str | Sequence[str], ts: str, grain: str = "hour") -> DataFrame:
    """Mean and longest time in seconds between consecutive rows.

    The mean telescopes to (last - first) / (n - 1); the longest gap lies inside a
    calendar bucket or between two neighbouring ones.
    """
    names = scale.as_keys(key)
    b = df.select(*names, ts).withColumn("_bucket", scale.calendar_bucket(F.col(ts).cast("timestamp"), grain))
    inside = Window.partitionBy(*names, "_bucket").orderBy(ts)
    stepped = b.withColumn("_s", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_gap", F.col("_s") - F.lag("_s").over(inside))
    per = stepped.groupBy(*names, "_bucket").agg(F.min("_s").alias("_a"), F.max("_s").alias("_b"), F.max("_gap").alias("_g"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*names).orderBy("_bucket")
    per = per.withColumn("_across", F.col("_a") - F.lag("_b").over(w))
    return per.groupBy(*names).agg(
        F.sum("_n").alias("n"),
        F.when(F.sum("_n") > 1, (F.max("_b") - F.min("_a")) / (F.sum("_n") - 1) / 1e6).otherwise(0.0).alias("avg_gap_seconds"),
        F.coalesce(F.greatest(F.max("_g"), F.max("_across")) / 1e6, F.lit(0.0)).alias("max_gap_seconds"))


def bursts(df: DataFrame, key: str | Sequence[str], ts: str, k: int = 5, seconds: int = 3600) -> DataFrame:
    """Rows that start ``k`` events inside less than ``seconds``.

    Each row also visits the previous time slice of that length, so slices hold all
    they need and no key is ever in one task as a whole.
    """
    names = scale.as_keys(key)
    micros = seconds * 1_000_000
    moment = F.unix_micros(F.col(ts).cast("timestamp"))
    slot = F.floor(moment / micros).cast("long")
    spread = df.select(*names, ts, moment.alias("_s"), slot.alias("_own"), F.explode(F.array(slot, slot - 1)).alias("_slot"))
    w = Window.partitionBy(*names, "_slot").orderBy("_s")
    ahead = spread.withColumn("_later", F.lead("_s", k - 1).over(w)).where(F.col("_slot") == F.col("_own"))
    span = F.col("_later") - F.col("_s")
    return ahead.where(span < micros).select(*names, F.col(ts).alias("burst_start"), (span / 1e6).alias("span_seconds"))


def calendar(df: DataFrame, ts: str) -> DataFrame:
    """Day of week (Monday = 0), month and quarter."""
    return df.withColumns({"day_of_week": F.weekday(ts), "month": F.month(ts), "quarter": F.quarter(ts)})


def zscore(df: DataFrame, key: str | Sequence[str], val: str, *, out: str = "zscore") -> DataFrame:
    """Distance from the key's mean in sample standard deviations; mean and deviation stay for the way back."""
    both = scale.with_totals(df, key, {f"{val}_mean": F.avg(val), f"{val}_std": F.stddev_samp(val)})
    return both.withColumn(out, F.when(F.col(f"{val}_std") != 0, (F.col(val) - F.col(f"{val}_mean")) / F.col(f"{val}_std")))


def unzscore(df: DataFrame, z: str, val: str, *, out: str = "value") -> DataFrame:
    """Undo :func:`zscore`."""
    return df.withColumn(out, F.col(z) * F.col(f"{val}_std") + F.col(f"{val}_mean"))


def training_windows(df: DataFrame, key: str, ts: str, val: str, context: int, horizon: int, *, split: int | None = None) -> DataFrame:
    """Arrays of the last ``context`` values and the next ``horizon`` values; incomplete windows are left out."""
    def arrays(w):
        return {"features": F.collect_list(val).over(w.rowsBetween(-(context - 1), 0)),
                "targets": F.collect_list(val).over(w.rowsBetween(1, horizon))}
    out = scale.over_rows(df.select(key, ts, val), key, ts, arrays, back=context - 1, ahead=horizon, split=split)
    return out.where((F.size("features") == context) & (F.size("targets") == horizon))


def context_features(df: DataFrame, key: str, ts: str, val: str, context: int = 30, *, split: int | None = None) -> DataFrame:
    """Means over 7/14/30 rows, population deviation over 7/14 and momentum of each full context."""
    def stats(w):
        def full(c):
            return _full(w, context, F.col(val), c)
        return {"mean_7": full(F.avg(val).over(_frame(w, 7))), "mean_14": full(F.avg(val).over(_frame(w, 14))),
                "mean_30": full(F.avg(val).over(_frame(w, 30))), "std_7": full(F.stddev_pop(val).over(_frame(w, 7))),
                "std_14": full(F.stddev_pop(val).over(_frame(w, 14))), "momentum": full(F.col(val) - F.lag(val, context - 1).over(w))}
    out = scale.over_rows(df, key, ts, stats, back=max(context, 30) - 1, split=split)
    return out.where(F.col("mean_7").isNotNull())


def time_split(df: DataFrame, key: str, ts: str, test: float = 0.2, *, tie: Sequence[Column] = (), grain: str | None = None) -> DataFrame:
    """Mark the earliest rows of every key as train and the last share as test."""
    ix = scale.row_index(df, key, ts, tie=tie, grain=grain, name="_ix", total="_n")
    part = F.when(F.col("_ix") < F.floor(F.col("_n") * (1 - test)), "train").otherwise("test")
    return ix.withColumn("part", part).drop("_ix", "_n")


def synth_open(df: DataFrame, key: str, ts: str, *, open_col: str = "open", close_col: str = "close", split: int | None = None) -> DataFrame:
    """Missing open = previous close, else the row's own close."""
    out = scale.over_rows(df, key, ts, lambda w: {"_prev": F.lag(close_col).over(w)}, back=1, split=split)
    return out.withColumn(open_col, F.coalesce(open_col, "_prev", close_col)).drop("_prev")


# Interval labels and their durations; ``1M`` is the calendar month.
INTERVALS = {"1m": "1 minute", "3m": "3 minutes", "5m": "5 minutes", "15m": "15 minutes", "30m": "30 minutes", "1h": "1 hour", "2h": "2 hours", "4h": "4 hours",
             "6h": "6 hours", "8h": "8 hours", "12h": "12 hours", "1d": "1 day", "3d": "3 days", "1w": "7 days"}


def ohlc_bars(df: DataFrame, key: str, ts: str, price: str, size: str | None = None, interval: str = "1d", *, tie: str | None = None) -> DataFrame:
    """Open, high, low, close, volume and tick count per key and interval; weeks start on Monday, months are calendar months."""
    if interval == "1M":
        start = F.date_trunc("month", ts)
    else:
        start = F.window(ts, INTERVALS[interval], startTime="4 days" if interval == "1w" else None)["start"]
    place = F.struct(ts, tie) if tie else F.col(ts)
    volume = F.sum(size) if size else F.count(F.lit(1)).cast("double")
    return df.groupBy(key, start.alias("bar_start")).agg(
        F.min_by(price, place).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, place).alias("close"), volume.alias("volume"), F.count(F.lit(1)).alias("ticks"))


def minmax(df: DataFrame, val: str, by: str | Sequence[str] | None = None, *, out: str | None = None) -> DataFrame:
    """Rescale to 0..1, rounded to three digits; a batch of equal values stays as it is."""
    both = scale.with_totals(df, by, {"_lo": F.min(val), "_hi": F.max(val)})
    scaled = F.round((F.col(val) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), 3)
    return both.withColumn(out or val, F.when(F.col("_hi") > F.col("_lo"), scaled).otherwise(F.col(val))).drop("_lo", "_hi")


def trend_text(change: Column) -> Column:
    """up / down / flat within one percent."""
    return above(change, [(1.0, "up"), (-1.0, "flat")], "down")
