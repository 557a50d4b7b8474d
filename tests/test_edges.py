"""Inputs the tables do not hold: nulls in keys and times, reversed bounds, odd cells, long arrays, all bar lengths."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import lexicons as L
from tidemark import scale
from tidemark.operators import forecast, joins, series, text
from tidemark.sources import files
from tidemark.streaming import streams


def at(second):
    return datetime.datetime(2024, 1, 3, 12, 0) + datetime.timedelta(seconds=second)


@pytest.fixture(scope="module")
def holes(spark):
    rows = [("a", at(0), 1.0), ("a", at(60), 2.0), ("a", None, 9.0), (None, at(30), 4.0), (None, at(90), 2.0)]
    return spark.createDataFrame(rows, "k string, ts timestamp, v double")


@pytest.mark.parametrize("fn", [
    lambda df, s: series.sma(df, "k", "ts", "v", 2, split=s), lambda df, s: series.pct_change(df, "k", "ts", "v", split=s), lambda df, s: series.rsi(df, "k", "ts", "v", 2, split=s)])
def test_splitting_keeps_rows_with_nulls(holes, fn):
    whole, cut = fn(holes, None), fn(holes, 2)
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.select(whole.columns).collect())) and cut.count() == 5


def test_drawdown_and_fill_keep_rows_with_nulls(holes):
    assert series.drawdown(holes, "k", "ts", "v").count() == 5
    got = scale.carry_forward(holes.withColumn("w", F.when(F.col("v") < 3, F.col("v"))), "k", "ts", {"f": "w"})
    assert sorted((str(r["k"]), r["v"], r["f"]) for r in got.collect() if r["k"] is None) == [("None", 2.0, 2.0), ("None", 4.0, None)]


def test_interval_stats_of_odd_bounds(spark):
    points = spark.createDataFrame([(1, at(0), at(100)), (2, None, at(100)), (3, at(100), at(0)), (4, at(0), None), (1, at(0), at(100)), (5, at(500), at(900))], "id int, lo timestamp, hi timestamp")
    events = spark.createDataFrame([(at(10), 2.0), (at(100), 4.0), (at(3000), 1.0), (at(20), None)], "ts timestamp, v double")
    got = joins.interval_stats(points, events, lo="lo", hi="hi", ts="ts", value="v").collect()
    assert sorted((r["id"], r["n"], r["total"], r["mean"]) for r in got) == [(1, 2, 6.0, 3.0), (1, 2, 6.0, 3.0), (2, 0, None, None), (3, 0, None, None), (4, 0, None, None), (5, 0, None, None)]


def test_one_odd_cell_does_not_spoil_a_file(spark):
    df = spark.createDataFrame([("f", "2024-01-02"), ("f", "2024-01-03"), ("f", "soon"), ("g", "31/12/2024"), ("h", "never")], "file string, t string")
    found = {r["file"]: (r["date_format"], r["n_rejected"]) for r in files.detect_date_format(df, "t", "file").collect()}
    assert found["f"] == ("yyyy-M-d", 1) and found["g"] == ("d/M/yyyy", 0) and found["h"] == (None, 1)
    got = df.join(files.detect_date_format(df, "t", "file"), "file").select(files.parse_detected(F.col("t"), F.col("date_format")).alias("ts")).collect()
    assert sum(r["ts"] is not None for r in got) == 3


def test_first_header_wins(spark, tmp_path):
    (tmp_path / "ETH_USD.csv").write_text("time,close,volume\n2024-01-02,100,5\n\"# price date\",7,1\n")
    assert [(r["close"], r["volume"]) for r in files.read_ohlcv_csv(spark, str(tmp_path)).where("timestamp IS NOT NULL").collect()] == [(100.0, 5.0)]


def test_flatten_keeps_the_tail(spark):
    df = spark.createDataFrame([(1, [(i,) for i in range(5)]), (2, [(7,)])], "id int, list array<struct<v:int>>")
    got = {r["id"]: r.asDict() for r in files.flatten(df, positions=2).collect()}
    assert got[1] == {"id": 1, "list_0_v": 0, "list_1_v": 1, "list_rest": '[{"v":2},{"v":3},{"v":4}]'} and got[2]["list_rest"] is None


@pytest.mark.parametrize("label", [*series.INTERVALS, "1M"])
def test_every_bar_length(spark, label):
    df = spark.createDataFrame([("a", at(0), 1.0, 1), ("a", at(0), 2.0, 2)], "k string, ts timestamp, p double, i int")
    row = series.ohlc_bars(df, "k", "ts", "p", interval=label, tie="i").first()
    assert (row["open"], row["close"], row["ticks"]) == (1.0, 2.0, 2)
    if label == "1w":
        assert row["bar_start"].weekday() == 0


def test_lists_are_whole():
    assert len(L.RISK_INDICATORS) == 50 and {"stake", "pool"} <= set(L.DEFI_WORDS)
    assert len(series.INTERVALS) + 1 == 15


def test_indicators_ignore_case(spark):
    df = spark.createDataFrame([("A PEP on a P2P Platform",)], "t string")
    assert text.domain_risks(df, "t").first()["indicators"] == ["P2P platform".lower(), "pep"]


def test_supply_has_its_unit(spark):
    df = spark.createDataFrame([("Total supply of 21 million coins",), ("max supply: 1,000,000",), ("nothing",)], "t string")
    assert [r["token_supply"] for r in text.technical_doc_features(df, "t").collect()] == [21e6, 1e6, None]


def test_alerts_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 90.0, "High", ["x"])] * 3, "symbol string, risk_score double, risk_category string, risk_factors array<string>")
    for _ in range(3):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = streams.ingest_stream(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    streams.alert_sink(s, str(tmp_path / "rows"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 2


def test_boosting_beats_the_mean(spark):
    rows = [(i, [float(i % 7), float(i % 3)], [float((i % 7) ** 2), float(i % 7)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, features array<double>, targets array<double>")
    models = forecast.fit_multistep(df.where("id < 150"), "boosting", 2, trees=10, depth=3)
    got = forecast.predict_multistep(models, df.where("id >= 150"), keep=["id"]).withColumnRenamed("prediction", "predicted")
    actual = df.select("id", F.posexplode("targets").alias("p", "observed")).withColumn("step", F.col("p") + 1)
    rows = {r["step"]: r for r in forecast.evaluate(got, actual, ["id", "step"], by=["step"]).collect()}
    assert rows[1]["mae"] < 6 and rows[2]["mae"] < 1 and rows[1]["n"] == rows[2]["n"] == 50


def test_steps_of_one_fit(spark):
    """Linear steps equal numpy's least squares, incomplete windows are left out, and the number of jobs does not grow with the steps."""
    rng = np.random.default_rng(5)
    x = rng.normal(1e6, 3.0, (400, 3))
    y = np.stack([x @ [0.5, -2.0, 1.0] + 4 + rng.normal(0, 0.1, 400) + s for s in range(6)], axis=1)
    rows = [(i, x[i].tolist(), y[i].tolist()) for i in range(400)]
    bad = [(900, [1.0, None, 2.0], y[0].tolist()), (901, x[0].tolist(), [1.0]), (902, None, None), (903, [float("nan")] * 3, y[0].tolist())]
    df = spark.createDataFrame(rows + bad, "id int, features array<double>, targets array<double>").repartition(3)
    tracker, jobs = spark.sparkContext.statusTracker(), {}
    for h in (2, 6):
        spark.sparkContext.setJobGroup(f"fit-{h}", "fit")
        model = forecast.fit_multistep(df, "linear", h)
        jobs[h] = len(tracker.getJobIdsForGroup(f"fit-{h}"))
        spark.sparkContext.setJobGroup("rest", "rest")
        want = np.linalg.lstsq(np.c_[np.ones(400), x - x.mean(0)], y[:, :h], rcond=None)[0]
        got = {(r["id"], r["step"]): r["prediction"] for r in forecast.predict_multistep(model, df.where("id < 400"), keep=["id"]).collect()}
        fitted = np.c_[np.ones(400), x - x.mean(0)] @ want
        assert len(got) == 400 * h and max(abs(got[i, s + 1] - fitted[i, s]) for i in range(400) for s in range(h)) < 1e-5
    assert jobs[2] == jobs[6] > 0
    with pytest.raises(ValueError):
        forecast.fit_multistep(df.limit(0), "forest", 2)
