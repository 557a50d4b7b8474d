"""Split work must give the same result as whole work, also for a hot key."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.operators import joins, ranking, series


@pytest.fixture(scope="module")
def ticks(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.randrange(0, 400_000), rng.choice([None, 1.0, 2.5, -3.0, 7.25])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, id long, at long, v double")
    return df.withColumn("ts", F.timestamp_seconds("at")).withColumn("x", F.col("id") % 17 + F.lit(0.5)).repartition(7).persist()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_row_index(ticks):
    got = rows(scale.row_index(ticks, "k", "ts", tie=[F.col("id")], total="n").select("k", "id", "row_index", "n"), "k", "id")
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = rows(ticks.select("k", "id", (F.row_number().over(w) - 1).cast("long").alias("i"), F.count("*").over(Window.partitionBy("k")).alias("n")), "k", "id")
    assert got == want


@pytest.mark.parametrize("forward", [True, False])
def test_carry_forward(ticks, forward):
    got = rows(scale.carry_forward(ticks, "k", "ts", {"f": "v"}, tie=[F.col("id")], grain="hour", forward=forward).select("k", "id", "f"), "k", "id")
    w = Window.partitionBy("k").orderBy("ts", "id")
    fn = F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if forward else F.first("v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    assert got == rows(ticks.select("k", "id", fn.alias("f")), "k", "id")


def test_top_per_key(ticks):
    got = rows(ranking.top_k_per(ticks.select("k", "id", "x"), "k", "x", 5, tie=[F.col("id")], rank="r"), "k", "r")
    w = Window.partitionBy("k").orderBy(F.col("x").desc(), "id")
    assert got == rows(ticks.select("k", "id", "x", F.row_number().over(w).alias("r")).where("r <= 5"), "k", "r")


@pytest.mark.parametrize("fn", [
    lambda df, s: series.sma(df, "k", "ts", "x", 6, split=s), lambda df, s: series.with_lead(df, "k", "ts", "x", [1, 3], split=s),
    lambda df, s: series.rsi(df, "k", "ts", "x", 5, split=s), lambda df, s: series.bollinger(df, "k", "ts", "x", 8, split=s),
    lambda df, s: series.momentum(df, "k", "ts", "x", 4, split=s), lambda df, s: series.training_windows(df, "k", "ts", "x", 4, 2, split=s)])
def test_split_series(ticks, fn):
    unique = ticks.groupBy("k", "ts").agg(F.min("id").alias("id"), F.max("x").alias("x"))
    whole, cut = fn(unique, None), fn(unique, 11)
    assert rows(whole, "k", "ts") == rows(cut.select(whole.columns), "k", "ts")


@pytest.mark.parametrize("split", [1, 7, 90, 65_536])
def test_split_ewma_is_that_of_the_whole_series(ticks, split):
    """Every block size gives what pandas gives for whole series, also around values that are missing (a quarter of v, and all of some blocks)."""
    holes = ticks.groupBy("k", "ts").agg(F.max("x").alias("x"), F.max("v").alias("v")).withColumn("v", F.when(F.minute("ts") > 5, F.col("v"))).where("k <> 'c' OR v IS NULL")
    for val in ("x", "v") if split != 1 else ("v",):
        got = series.ewma(holes, "k", "ts", val, {"e": 3, "f": 400}, split=split).toPandas().sort_values(["k", "ts"])
        got = got.where(got.notna(), np.nan)
        for _, part in got.groupby("k"):
            for name, span in (("e", 3), ("f", 400)):
                want = part[val].astype("float64").ewm(span=span, adjust=False).mean()
                assert np.allclose(part[name].astype("float64"), want, rtol=1e-12, atol=1e-14, equal_nan=True)


def test_split_macd(ticks):
    unique = ticks.groupBy("k", "ts").agg(F.max("x").alias("x"))
    got = series.macd(unique, "k", "ts", "x", 3, 8, 4, split=40).toPandas().sort_values(["k", "ts"])
    for _, part in got.groupby("k"):
        line = part["x"].ewm(span=3, adjust=False).mean() - part["x"].ewm(span=8, adjust=False).mean()
        signal = line.ewm(span=4, adjust=False).mean()
        assert np.allclose(part["macd"], line) and np.allclose(part["macd_signal"], signal) and np.allclose(part["macd_hist"], line - signal)


@pytest.fixture(scope="module")
def burst_of_rows(spark):
    """40,000 rows over four years, a third of them on one day."""
    at = F.when(F.col("id") % 3 == 0, F.lit(800 * 86400) + F.col("id") % 86400).otherwise(F.pmod(F.xxhash64("id"), F.lit(1460 * 86400)))
    return spark.range(40_000).select("id", at.alias("at")).select("id", F.timestamp_seconds("at").alias("ts"), (F.col("id") % 101).cast("double").alias("v"))


def test_time_buckets_are_even(burst_of_rows):
    counts = sorted(r["count"] for r in scale.time_bucket(burst_of_rows, "ts").groupBy("_bucket").count().collect())
    assert len(counts) >= 16 and counts[-1] < 2 * sum(counts) / len(counts)
    days = scale.time_bucket(burst_of_rows, "ts", "day").groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert days > 13_000
    ordered = scale.time_bucket(burst_of_rows, "ts").groupBy("_bucket").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy("_bucket").collect()
    assert all(x["b"] < y["a"] for x, y in zip(ordered, ordered[1:]))


def test_time_buckets_of_odd_times(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([None, 5, 5, 5, None, 7])], "id long, at long").withColumn("ts", F.timestamp_seconds("at"))
    got = {r["id"]: r["_bucket"] for r in scale.time_bucket(df, "ts").collect()}
    assert got[0] == got[4] == 0 and got[1] == got[2] == got[3] <= got[5]
    assert scale.time_bucket(df.limit(0), "ts").count() == 0 and scale.time_bucket(df.where("at IS NULL"), "ts").count() == 2


def test_asof_join_without_keys(spark, burst_of_rows):
    left, right = burst_of_rows.where("id % 10 = 0").select("id", "ts"), burst_of_rows.where("id % 10 = 1").select("ts", "v", F.col("id").alias("seq"))
    joined = joins.asof_join(left, right, "ts", ["v"], order="seq")
    got = joined.select("id", "v").toPandas().sort_values("id", ignore_index=True)
    want = pd.merge_asof(left.toPandas().sort_values("ts"), right.toPandas().sort_values(["ts", "seq"]), on="ts").sort_values("id", ignore_index=True)
    assert np.allclose(got["v"].astype("float64"), want["v"].astype("float64"), equal_nan=True)


def test_running_extreme_and_index_of_a_hot_day(burst_of_rows):
    one = burst_of_rows.withColumn("k", F.lit("k"))
    w = Window.orderBy("ts", "id")
    got = rows(scale.row_index(one, "k", "ts", tie=[F.col("id")]).select("id", "row_index"), "id")
    assert got == rows(one.select("id", (F.row_number().over(w) - 1).cast("long").alias("i")), "id")
    unique = one.groupBy("k", "ts").agg(F.max("v").alias("v"))
    got = rows(scale.running_extreme(unique, "k", "ts", "v", "m").select("ts", "m"), "ts")
    assert got == rows(unique.select("ts", F.max("v").over(Window.orderBy("ts")).alias("m")), "ts")


def test_rows_without_a_key_have_totals(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", 9.0), ("a", 6.0), ("b", 2.0)], "k string, v double")
    got = sorted(((r["k"] or "", r["v"]) for r in series.minmax(df, "v", "k").collect()))
    assert got == [("", 0.0), ("", 1.0), ("a", 0.0), ("a", 0.25), ("a", 1.0), ("b", 2.0)]
    scored = sorted((r["k"] or "", r["zscore"] or 0.0) for r in series.zscore(df, "k", "v").collect())
    assert scored[0][1] == pytest.approx(-scored[1][1]) and scored[0][1] < 0


def test_exact_percentiles(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": ["hot"] * 4000 + ["b"] * 37, "v": np.concatenate([rng.lognormal(3, 2, 3000), np.zeros(500), -rng.lognormal(1, 1, 500), rng.normal(0, 1e-4, 37)])})
    df = spark.createDataFrame(pdf)
    qs = {"a": 0.01, "m": 0.5, "z": 0.99}
    got = {r["k"]: r for r in scale.exact_percentiles(df, "k", "v", qs).collect()}
    for k, part in pdf.groupby("k"):
        for name, q in qs.items():
            assert got[k][name] == pytest.approx(np.quantile(part["v"], q), rel=1e-9, abs=1e-12)
    disc = scale.exact_percentiles(df, None, "v", {"m": 0.5}, discrete=True).first()["m"]
    assert disc == np.sort(pdf["v"])[int(np.ceil(0.5 * len(pdf))) - 1]


def test_value_band_is_monotone(spark):
    xs = sorted([0.0, 1e-12, 1e-9, 1e-3, 0.5, 1, 1.01, 3, 1e6, 1e17, -1e-9, -0.5, -7, -1e9])
    df = spark.createDataFrame([(float(x),) for x in xs], "x double").select("x", scale.value_band(F.col("x")).alias("b"))
    bands = [r["b"] for r in df.orderBy("x").collect()]
    assert bands == sorted(bands)


def test_asof_join_brute_force(spark, ticks):
    left = ticks.where("id % 3 = 0").select("k", "ts", "id")
    right = ticks.where("id % 3 = 1").select("k", "ts", F.col("x").alias("price"), F.col("id").alias("seq"))
    got = rows(joins.asof_join(left, right, "ts", ["price"], by="k", order="seq", grain="hour").select("id", "price"), "id")
    r = right.toPandas()
    want = []
    for row in left.orderBy("id").collect():
        past = r[(r.k == row["k"]) & (r.ts <= row["ts"])].sort_values(["ts", "seq"])
        want.append((row["id"], past["price"].iloc[-1] if len(past) else None))
    assert got == want
    near = joins.asof_join(left, right, "ts", ["price"], by="k", order="seq", tolerance_seconds=60)
    assert near.where("price IS NOT NULL").count() < left.count()


def test_bursts_and_gaps_brute_force(ticks):
    pdf = ticks.select("k", "ts").toPandas().sort_values(["k", "ts"])
    want = 0
    for _, part in pdf.groupby("k"):
        s = part["ts"].astype("int64").to_numpy() // 1000
        want += sum((s[i + 4] - s[i]) < 1800 * 1_000_000 for i in range(len(s) - 4))
    assert series.bursts(ticks.select("k", "ts"), "k", "ts", 5, 1800).count() == want
    stats = {r["k"]: r for r in series.gap_stats(ticks, "k", "ts").collect()}
    for k, part in pdf.groupby("k"):
        diffs = part["ts"].diff().dt.total_seconds().dropna()
        assert stats[k]["max_gap_seconds"] == pytest.approx(diffs.max()) and stats[k]["avg_gap_seconds"] == pytest.approx(diffs.mean())


def test_half_trend_with_hot_key(ticks):
    got = {r["k"]: r["trend"] for r in series.half_trend(ticks, "k", "ts", "x", tie=[F.col("id")]).collect()}
    for k, part in ticks.toPandas().sort_values(["k", "ts", "id"]).groupby("k"):
        half = len(part) // 2
        assert got[k] == pytest.approx(part["x"].iloc[half:].mean() - part["x"].iloc[:half].mean())


def test_interval_stats_equals_pairing(ticks):
    points = ticks.where("id % 5 = 0").select("k", "id", F.col("ts").alias("lo"), (F.col("ts") + F.expr("INTERVAL 3 HOURS")).alias("hi"))
    points = points.unionByName(points.where("id = 0"))
    events = ticks.select("k", "ts", "v")
    fast = joins.interval_stats(points, events, lo="lo", hi="hi", ts="ts", value="v", keys=["k"])
    slow = joins.interval_agg_join(points, events, lo="lo", hi="hi", ts="ts", keys=["k"], grain="hour",
                                   aggs={"n": F.count("v"), "total": F.sum("v")}).withColumn("n", F.coalesce("n", F.lit(0)))
    unique = slow.distinct()
    assert rows(fast.select("k", "id", "n", "total").distinct(), "k", "id") == rows(unique.select("k", "id", "n", "total"), "k", "id")
    assert fast.count() == points.count()


@pytest.mark.parametrize("ascending", [True, False])
def test_deep_pages(spark, ascending):
    """A third of the rows share a value, some have none; every page equals the plain one."""
    data = [(i, None if i % 50 == 0 else 7.0 if i % 3 == 0 else float("nan") if i % 101 == 0 else float(i * 37 % 400)) for i in range(6000)]
    df = spark.createDataFrame(data, "id int, x double").repartition(5)
    how = {"sort": "x", "ascending": ascending, "tie": [F.col("id")]}
    for offset, limit in ((0, 5), (1990, 40), (2500, 1500), (5990, 30), (7000, 5)):
        want = [r["id"] for r in ranking.page(df, limit=limit, offset=offset, **how).collect()]
        assert [r["id"] for r in ranking.deep_page(df, limit=limit, offset=offset, **how).collect()] == want
    assert ranking.deep_page(df.limit(0), limit=5, offset=0, **how).count() == 0


def test_deep_page_sorts_few_rows(spark):
    """The window that numbers rows reads the ranges of the page only, and no task holds all rows."""
    df = spark.range(200_000).select("id", (F.col("id") % 3 == 0).cast("int").alias("x"))
    got = ranking.deep_page(df, sort="x", offset=150_000, limit=10, tie=[F.col("id")])
    assert got.columns == ["id", "x"] and [r["id"] for r in got.collect()] == [r["id"] for r in ranking.page(df, sort="x", offset=150_000, limit=10, tie=[F.col("id")]).collect()]
    plan = got._jdf.queryExecution().toString()
    assert "WindowGroupLimit" not in plan and "hashpartitioning(_range" in plan
