"""Forecasts, ensembles and forecast evaluation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.functions.ladders import above
from tidemark.operators import ranking, series


def trend_label(change: Column) -> Column:
    """Five-level trend of a change in percent."""
    return (F.when(change > 5, "strongly bullish").when(change > 1, "bullish").when(change < -5, "strongly bearish").when(change < -1, "bearish").otherwise("neutral"))


def forecast_wma(df: DataFrame, key: str, ts: str, val: str, h: int = 7, *, min_rows: int = 30, seed: int | None = None, split: int | None = None) -> DataFrame:
    """Weighted moving-average forecast: 0.5/0.3/0.2 of the last 7/14/30-row means, mean daily drift, widening bounds.

    Without ``seed`` there is no random part; with it, half a standard deviation of noise is drawn per step.
    """
    tail = scale.top_per_key(df.select(key, ts, val), key, [F.col(ts).desc()], 30, rank="_age")
    means = tail.groupBy(key).agg(*[F.avg(F.when(F.col("_age") <= n, F.col(val))).alias(f"_ma{n}") for n in (7, 14, 30)],
                                  F.max_by(val, ts).alias("current"), F.max(ts).alias("_last"))
    moves = series.pct_change(df.select(key, ts, val), key, ts, val, out="_r", split=split)
    # The drift is taken over the rows for which all features exist, i.e. from the 30th row on.
    moves = scale.row_index(moves, key, ts, name="_i")
    stats = moves.where(F.col("_i") >= min_rows - 1).groupBy(key).agg(F.avg("_r").alias("_drift"), F.stddev_samp("_r").alias("_sd"))
    base = means.join(stats, key).withColumn("_w", F.col("_ma7") * 0.5 + F.col("_ma14") * 0.3 + F.col("_ma30") * 0.2)
    steps = base.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h))))
    noise = F.lit(0.0) if seed is None else F.coalesce("_sd", F.lit(0.0)) * F.randn(seed)
    steps = steps.withColumn("_noise", noise)
    steps = steps.withColumn("forecast", F.greatest(F.lit(0.01), F.col("_w") * (1 + F.col("_drift") * F.col("step")) * (1 + F.col("_noise") * 0.5)))
    band = F.col("step") * 0.01 + F.col("_noise") * 0.1
    return steps.select(
        key, "step", F.date_add(F.to_date("_last"), F.col("step")).alias("forecast_date"), "forecast", ((F.col("forecast") / F.col("current") - 1) * 100).alias("change_pct"),
        (F.col("forecast") * (1 - band)).alias("lower"), (F.col("forecast") * (1 + band)).alias("upper"), "current")


def forecast_trend(df: DataFrame, key: str, ts: str, val: str, h: int = 7, *, days: int = 7, width: float = 0.005, min_rows: int = 30) -> DataFrame:
    """Last value moved on by the trend of the last ``days`` rows, bounds of 0.5 % per step."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    tail = scale.top_per_key(df.select(key, ts, val), key, [F.col(ts).desc()], days + 1, rank="_age")
    ends = tail.groupBy(key).agg(F.max(F.when(F.col("_age") == 1, F.col(val))).alias("current"), F.max(F.when(F.col("_age") == days + 1, F.col(val))).alias("_old"),
                                 F.max(ts).alias("_last")).join(counts, key, "left_semi")
    trend = F.when(F.col("_old") != 0, F.col("current") / F.col("_old") - 1).otherwise(0.0)
    steps = ends.withColumn("_t", trend).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h))))
    steps = steps.withColumn("forecast", F.col("current") * (1 + F.col("_t") * F.col("step") / days))
    return steps.select(key, "step", F.date_add(F.to_date("_last"), F.col("step")).alias("forecast_date"), "forecast",
                        (F.col("forecast") * (1 - width * F.col("step"))).alias("lower"), (F.col("forecast") * (1 + width * F.col("step"))).alias("upper"), "current")


@dataclass(frozen=True)
class LinearSteps:
    """Intercepts and coefficients of all forecast steps: one row of ``weights`` per step, intercept first."""

    weights: tuple[tuple[float, ...], ...]

    def predict(self, windows: DataFrame, features: str, keep: Sequence[str]) -> DataFrame:
        sums = [F.aggregate(F.zip_with(F.col(features), F.array(*[F.lit(w) for w in row[1:]]), lambda x, w: x * w), F.lit(row[0]), lambda a, b: a + b) for row in self.weights]
        rows = windows.select(*keep, F.posexplode(F.array(*sums)).alias("_i", "prediction"))
        return rows.select(*keep, (F.col("_i") + 1).alias("step"), "prediction")


@dataclass(frozen=True)
class TreeSteps:
    """One ensemble of trees for all steps; the step is its last input."""

    model: Any
    h: int

    def predict(self, windows: DataFrame, features: str, keep: Sequence[str]) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        steps = windows.withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(self.h))))
        inputs = steps.withColumn("_x", array_to_vector(F.concat(F.col(features), F.array(F.col("_step").cast("double")))))
        return self.model.transform(inputs).select(*keep, F.col("_step").alias("step"), "prediction")


def _gram(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of outer products of the rows of ``_v``, arrays of ``size`` numbers: one small matrix per task, added up by Spark."""

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for batch in batches:
            if len(batch):
                m = np.vstack(batch["_v"].to_numpy())
                total += m.T @ m
        yield pd.DataFrame({"cells": [total.ravel()]})

    cells = rows.select("_v").mapInPandas(products, "cells array<double>").select(F.posexplode("cells").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    out = np.zeros(size * size)
    for r in cells.collect():  # size * size numbers, whatever the number of rows
        out[r["at"]] = r["x"]
    return out.reshape(size, size)


def _fit_linear(base: DataFrame, h: int) -> LinearSteps:
    """Least squares of all steps at once: a pass for the means, a pass that adds up the centred products of features and targets."""
    means = base.select(F.posexplode(F.concat("_x", "_t")).alias("at", "x")).groupBy("at").agg(F.avg("x").alias("x")).collect()
    centre = [r["x"] for r in sorted(means, key=lambda r: r["at"])]
    d = len(centre) - h
    if d < 1:
        raise ValueError("no training windows")
    gram = _gram(base.select(F.zip_with(F.concat("_x", "_t"), F.array(*[F.lit(c) for c in centre]), lambda x, c: x - c).alias("_v")), d + h)
    # Scaled to unit diagonal, so the cut-off for collinear features does not depend on their units.
    scaled = np.sqrt(np.where(np.diag(gram)[:d] > 0, np.diag(gram)[:d], 1.0))
    slopes = np.linalg.lstsq(gram[:d, :d] / np.outer(scaled, scaled), gram[:d, d:] / scaled[:, None], rcond=1e-12)[0] / scaled[:, None]
    intercepts = np.asarray(centre[d:]) - np.asarray(centre[:d]) @ slopes
    return LinearSteps(tuple((float(intercepts[s]), *map(float, slopes[:, s])) for s in range(h)))


def fit_multistep(windows: DataFrame, kind: str, h: int, *, features: str = "features", targets: str = "targets", seed: int = 42, trees: int = 20, depth: int = 5) -> LinearSteps | TreeSteps:
    """A fitted model of all ``h`` forecast steps; ``kind`` is ``forest``, ``boosting`` or ``linear``.

    The number of Spark jobs does not depend on ``h``: least squares solves all steps from one matrix of products, trees learn from rows (features, step)
    and split on the step where steps differ. Windows with a null feature or target, or with fewer than ``h`` targets, are left out; without any
    the fit raises ``ValueError``.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    if kind not in ("forest", "boosting", "linear"):
        raise ValueError(f"unknown kind of model: {kind}")
    x, t = F.col(features).cast("array<double>"), F.slice(F.col(targets).cast("array<double>"), 1, h)
    whole = ~F.exists(F.concat("_x", "_t"), lambda v: v.isNull() | F.isnan(v)) & (F.size("_t") == h)
    base = windows.select(x.alias("_x"), t.alias("_t")).where(whole).persist()
    try:
        if kind == "linear":
            return _fit_linear(base, h)
        if base.isEmpty():
            raise ValueError("no training windows")
        train = base.select("_x", F.posexplode("_t").alias("_i", "_y")).select(array_to_vector(F.concat("_x", F.array((F.col("_i") + 1).cast("double")))).alias("_x"), "_y")
        if kind == "forest":
            # Every tree may use the step: with all features on offer at each node, only the drawn rows differ.
            learner = RandomForestRegressor(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="all")
        else:
            learner = GBTRegressor(featuresCol="_x", labelCol="_y", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed)
        return TreeSteps(learner.fit(train), h)
    finally:
        base.unpersist()


def predict_multistep(model: LinearSteps | TreeSteps, windows: DataFrame, *, features: str = "features", keep: Sequence[str] = ()) -> DataFrame:
    """(kept columns, step, prediction) for every fitted step."""
    return model.predict(windows, features, keep)


def ensemble(preds: DataFrame, errors: DataFrame, on: Sequence[str], *, model: str = "model", mae: str = "mae", value: str = "prediction") -> DataFrame:
    """Blend models with weights proportional to 1 / MAE."""
    raw = errors.select(model, (1 / (F.col(mae) + 1e-10)).alias("_w"))
    weights = scale.with_totals(raw, None, {"_s": F.sum("_w")}).select(model, (F.col("_w") / F.col("_s")).alias("weight"))
    return preds.join(weights, model).groupBy(*on).agg(F.sum(F.col(value) * F.col("weight")).alias("blended"), F.count(F.lit(1)).alias("n_models"))


def evaluate(pred: DataFrame, actual: DataFrame, on: Sequence[str], *, by: Sequence[str] = (), predicted: str = "predicted", observed: str = "observed") -> DataFrame:
    """MAE, RMSE and MAPE over matching rows."""
    error = F.col(predicted) - F.col(observed)
    return pred.join(actual, list(on)).groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.when(F.col(observed) != 0, F.abs(error / F.col(observed)))) * 100).alias("mape"), F.count(F.lit(1)).alias("n"))


def improvement(new: Column, old: Column) -> Column:
    """Error reduction in percent."""
    return F.when(old != 0, (old - new) / old * 100)


def bands(samples: DataFrame, by: Sequence[str], value: str, qs: Mapping[str, float] | None = None) -> DataFrame:
    """Quantiles of sample paths per step (10 %, 50 %, 90 % by default)."""
    return scale.exact_percentiles(samples, list(by), value, qs or {"low": 0.1, "median": 0.5, "high": 0.9})


def insights(samples: DataFrame, current: DataFrame, *, key: str, step: str = "step", value: str = "value", price: str = "current") -> DataFrame:
    """Change, trend, probability of an increase, mean band width in percent and a sentence per symbol.

    ``samples``: (key, step, value) of many paths; ``current``: (key, current price).
    """
    b = bands(samples, [key, step], value)
    width = F.when(F.col("median") != 0, (F.col("high") - F.col("low")) / F.col("median") * 100).otherwise(0.0)
    per = b.groupBy(key).agg(F.avg(width).alias("avg_uncertainty"), F.max_by("median", step).alias("final_forecast"), F.max(step).alias("_h"))
    last = samples.join(per.select(key, F.col("_h").alias(step)), [key, step], "left_semi").join(current, key)
    chance = last.groupBy(key).agg((F.avg(F.when(F.col(value) > F.col(price), 1.0).otherwise(0.0)) * 100).alias("prob_increase"))
    out = per.drop("_h").join(current, key).join(chance, key).withColumn("change_pct", (F.col("final_forecast") / F.col(price) - 1) * 100)
    out = out.withColumn("trend", trend_label(F.col("change_pct")))
    p, u = F.col("prob_increase"), F.col("avg_uncertainty")
    odds = F.when(p > 75, "strong probability of an increase").when(p > 60, "moderate probability of an increase").when(p < 25, "strong probability of a decrease").when(
        p < 40, "moderate probability of a decrease").otherwise("uncertain direction")
    text = F.concat_ws(", ", F.concat(F.lit("Outlook "), "trend"), odds, F.concat(above(u, [(20, "high"), (10, "moderate")], "low"), F.lit(" uncertainty")))
    return out.withColumn("insight", text)


def compare_forecasts(fc: DataFrame, *, key: str, ts: str, change: str, trend: str, days: int, as_of: Column) -> DataFrame:
    """Forecasts of the last ``days``: count, most common trend and its share, mean change and direction flips."""
    recent = fc.where(F.col(ts) >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
    stats = recent.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.col(change), F.lit(0.0))).alias("avg_change"))
    common = ranking.mode_per(recent, key, trend).select(key, F.col(trend).alias("common_trend"), F.col("n").alias("_c"))
    flips = series.direction_changes(recent, key, ts, change).select(key, "direction_changes")
    return stats.join(common, key, "left").join(flips, key).withColumn("consistency_pct", F.col("_c") / F.col("n") * 100).drop("_c")


def explode_forecast(fc: DataFrame, keep: Sequence[str], *, dates: str = "forecast_dates", values: str = "forecast_values", lower: str = "lower_bounds", upper: str = "upper_bounds") -> DataFrame:
    """One row per forecast step from the stored arrays."""
    zipped = F.arrays_zip(F.col(dates).alias("d"), F.col(values).alias("v"), F.col(lower).alias("l"), F.col(upper).alias("u"))
    rows = fc.select(*keep, F.posexplode(zipped).alias("_i", "_z"))
    return rows.select(*keep, (F.col("_i") + 1).alias("step"), F.col("_z.d").alias("date"), F.col("_z.v").alias("forecast"), F.col("_z.l").alias("lower"), F.col("_z.u").alias("upper"))


def chart_series(history: DataFrame, steps: DataFrame, *, key: str, ts: str, val: str) -> DataFrame:
    """History and forecast rows of a chart in one table, each with the key's value range."""
    past = history.select(key, F.col(ts).alias("date"), F.col(val).alias("price"))
    both = past.unionByName(steps.select(key, "date", "forecast", "lower", "upper"), allowMissingColumns=True)
    low = F.min(F.least("price", "lower", "forecast"))
    high = F.max(F.greatest("price", "upper", "forecast"))
    return scale.with_totals(both, key, {"y_min": low, "y_max": high})


def winsorize(df: DataFrame, columns: Sequence[str], by: str | Sequence[str] | None = None, *, key: str | None = None, ts: str | None = None) -> DataFrame:
    """Clip to q01 - 3*iqr .. q99 + 3*iqr with iqr = q99 - q01; infinities become null first.

    With ``key`` and ``ts`` nulls are filled forward, then backward, before clipping; what is left becomes 0.
    """
    inf = [float("inf"), float("-inf"), float("nan")]
    out = df.withColumns({c: F.when(F.col(c).isin(inf[:2]) | F.isnan(c), F.lit(None)).otherwise(F.col(c)) for c in columns})
    if key and ts:
        out = series.fill(series.fill(out, key, ts, columns, "ffill"), key, ts, columns, "bfill").fillna(0, subset=list(columns))
    names = scale.as_keys(by)
    limits = scale.percentiles_of(out, names, columns, {"_a": 0.01, "_b": 0.99}).withColumnsRenamed({c: f"_q_{c}" for c in columns})
    if names:
        out = out.join(limits, names, "left")
    else:
        out = out.withColumn("_q", limits.select(F.struct(*[f"_q_{c}" for c in columns]).alias("q")).scalar()).withColumns({f"_q_{c}": F.col(f"_q._q_{c}") for c in columns}).drop("_q")
    for c in columns:
        low, high = F.col(f"_q_{c}._a"), F.col(f"_q_{c}._b")
        span = high - low
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), high + 3 * span), low - 3 * span))).drop(f"_q_{c}")
    return out


def confidence(fc: DataFrame, *, uncertainty: str = "average_uncertainty", trend: str = "trend") -> DataFrame:
    """High up to 5 % mean uncertainty, Medium up to 10 %, else Low, and the analyst's note."""
    u = F.col(uncertainty)
    note = (F.when(u > 10, "Volatility is elevated. Consider risk management.").when(F.col(trend).contains("bullish"), "Mild bullish signal.")
            .when(F.col(trend).contains("bearish"), "Mild bearish signal.").otherwise("No strong signal."))
    return fc.withColumn("confidence", F.when(u <= 5, "High").when(u <= 10, "Medium").otherwise("Low")).withColumn("note", note)


def forecast_table(steps: DataFrame, latest: str = "current") -> DataFrame:
    """Best and worst case and change in percent against the latest price per step."""
    return steps.select("*", F.col("upper").alias("best_case"), F.col("lower").alias("worst_case"),
                        F.when(F.col(latest) != 0, F.round((F.col("forecast") - F.col(latest)) / F.col(latest) * 100, 2)).alias("change_vs_latest"))
