"""Sources, sinks and streams on small files."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.sources import files, tables
from tidemark.streaming import streams


def test_price_csv(spark, tmp_path):
    (tmp_path / "AVAX_USD CoinW Historical Data.csv").write_text(
        '﻿"Date","Price","Open","High","Low","Vol.","Change %"\n"03/16/2025","91,867.5","90,000.0","92,000.0","89,500.0","9.27M","1.2%"\n"03/06/2025","90,100.0","90,000.0","90,200.0","89,000.0","1.69K","-0.4%"\n"03/05/2025","0","1","1","1","-","0%"\n', encoding="utf-8")
    (tmp_path / "Bitcoin Futures CME.csv").write_text("# export\ntime,close\n2024-01-02,100\n2024-01-03,101.5\nbroken line\n")
    df = files.with_exchange(files.with_symbol(files.read_ohlcv_csv(spark, str(tmp_path))))
    rows = sorted((r["symbol"], r["exchange"], r["timestamp"].date().isoformat(), r["open"], r["close"], r["volume"]) for r in df.collect())
    assert rows == [("AVAXUSD", "CoinW", "2025-03-06", 90000.0, 90100.0, 1690.0), ("AVAXUSD", "CoinW", "2025-03-16", 90000.0, 91867.5, 9270000.0),
                    ("BTCUSD", "CME", "2024-01-02", 100.0, 100.0, 0.0), ("BTCUSD", "CME", "2024-01-03", 101.5, 101.5, 0.0)]


def test_articles_and_corpus(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "source": "wire",\n "title": "T", "url": "u", "content": "c", "date": 1700000000000, "authors": null}')
    row = files.read_articles(spark, str(tmp_path / "*.json")).first()
    assert row["date"].isoformat() == "2023-11-14T22:13:20" and row["authors"] == []
    (tmp_path / "n.txt").write_text("line one\nline two")
    row = files.read_corpus(spark, str(tmp_path / "*.txt")).first()
    assert row["text"] == "line one\nline two" and row["file_name"] == "n.txt" and row["file_size"] == 17


def test_html(spark):
    page = "<html><head><title>A &amp; B</title><style>p{}</style></head><body><nav>menu</nav><article><p>One<br>two</p><script>x('</p>')</script></article></body></html>"
    row = files.html_to_text(spark.createDataFrame([(page,)], "h string"), "h").first()
    assert (row["title"], row["text"]) == ("A & B", "One two")


def test_write_table_counts_bad_rows(spark, tmp_path):
    df = spark.createDataFrame([("a", "1.5"), ("b", "x"), (None, "2"), ("c", None)], "symbol string, price string")
    counts = tables.write_table(df, str(tmp_path / "t"), {"symbol": "string", "price": "double"}, defaults={"price": 0.0}, required=["symbol"]).first()
    assert (counts["good"], counts["bad"]) == (2, 2)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [("a", 1.5), ("c", 0.0)]


def test_validation_reasons(spark):
    df = spark.createDataFrame([("Liquidity", "7"), ("", "70"), ("Custody", "bad"), ("Market", "500")], "factor string, rating string")
    rows = quality.validate(df, "risk").collect()
    assert [r["rating"] for r in rows] == [7.0, 7.0, 5.0, 10.0] and rows[1]["reasons"] == ["missing factor"]
    market = quality.validate(spark.createDataFrame([("5",), ("-1",), ("?",)], "price string"), "market").collect()
    assert [r["reasons"] for r in market] == [[], ["negative price"], ["price is not a number"]]


@pytest.fixture()
def feed(spark, tmp_path):
    rows = [("a", 1, 10.0), ("a", 100, 12.0), ("b", 130, 5.0), ("a", 1000, 9.0), ("a", 1, 10.0), ("b", 2000, 7.0), ("a", 5000, 1.0)]
    df = spark.createDataFrame([(i, k, s, v) for i, (k, s, v) in enumerate(rows)], "id long, k string, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    for part in range(3):
        df.where(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, str(tmp_path / "in"), tmp_path


def test_stream_equals_batch(spark, feed):
    df, path, _ = feed
    for fn in (lambda x: streams.bars_stream(x, "k", "ts", "v"), lambda x: streams.sessions(x, "k", "ts", "10 minutes", "1 day"),
               lambda x: streams.latest_stream(x, "k", "ts", ["v"])):
        live = streams.run_once(fn(streams.ingest_stream(spark, path, df.schema, files_per_trigger=1)), "t")
        assert sorted(map(tuple, live.collect())) == sorted(map(tuple, fn(df).collect()))


def test_stream_dedupe_over_batches(spark, feed):
    df, path, _ = feed
    keyed = streams.ingest_stream(spark, path, df.schema, files_per_trigger=1).withColumn("key", F.concat("k", F.col("s").cast("string")))
    got = streams.run_once(streams.dedupe_stream(keyed, "key", "ts", "1 day"), "d", mode="append")
    assert got.count() == 6


def in_batches(spark, folder, batches, schema="k string, s long"):
    """A stream that reads one batch of rows after the other."""
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(f"{folder}/{i:03}")
    shape = spark.read.parquet(f"{folder}/000").schema
    return streams.ingest_stream(spark, f"{folder}/*", shape, files_per_trigger=1, options={"maxFileAge": "10000d"})


def test_bursts_on_any_alignment(spark, tmp_path):
    """Bursts across the starts of hours and of batches, events that come late but in time, one that comes too late, quiet keys, a key without a name."""
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), 1_000_000 + int(rng.expovariate(1 / 900) + i * 240)) for i in range(400)]
    rows += [("c", 1_000_800 + 900 * i) for i in range(6)] + [("d", 1_050_000 + 899 * i) for i in range(5)]
    rows.sort(key=lambda r: r[1] + rng.randrange(0, 3000))
    batches = [rows[i : i + 60] for i in range(0, len(rows), 60)] + [[("z", 3_000_000)], [("a", 1_000_001)] * 9]
    live = streams.run_once(streams.burst_stream(in_batches(spark, str(tmp_path / "in"), batches), "k", "ts", 5, 3600, delay="2 hours"), "t", mode="append")
    whole = spark.createDataFrame(rows, "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    key = lambda r: (r[0] or "", r[1], r[2])
    got, want = sorted(map(tuple, live.collect()), key=key), sorted(map(tuple, streams.burst_stream(whole, "k", "ts", 5, 3600).collect()), key=key)
    assert got == want and {r[0] for r in got} == {"a", "b", "d", None} and len(got) > 20


def test_burst_state_is_kept_by_slot(spark, tmp_path):
    """One key over a day: no state holds more than a slot of it and the start of the next, and bursts across the slots' edges are found."""
    rows = [("a", 3600 * h + s) for h in range(1, 25) for s in (-20, -10, 0, 10, 1800)]
    live = streams.burst_stream(in_batches(spark, str(tmp_path / "in"), [rows]), "k", "ts", 3, 60, delay="1 second")
    run = streams.start_batches(live, lambda batch, n: batch.write.parquet(str(tmp_path / f"out/n={n}")), str(tmp_path / "state"))
    run.awaitTermination()
    assert max(p.stateOperators[0].numRowsTotal for p in run.recentProgress if p.stateOperators) > 48
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).drop("n").collect()))
    whole = spark.createDataFrame(rows, "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert len(got) == 48 and got == sorted(map(tuple, streams.burst_stream(whole, "k", "ts", 3, 60).collect()))


def test_single_events_are_bursts_of_one(spark, tmp_path):
    s = in_batches(spark, str(tmp_path / "in"), [[("a", 10), ("a", 10)], [("a", 5000)], [("z", 90_000)]])
    assert streams.run_once(streams.burst_stream(s, "k", "ts", 1, 60, delay="1 second"), "t", mode="append").count() == 3


def test_alerts_do_not_read_what_was_written(spark, tmp_path):
    """A batch succeeds although the folder of an earlier one is unreadable, and repeats nothing."""
    def source():
        reader = spark.readStream.schema("symbol string, risk_score double").json(str(tmp_path / "in"))
        return reader.withColumns({"risk_category": F.lit("x"), "risk_factors": F.array().cast("array<string>")})

    (tmp_path / "in").mkdir()
    for i, rows in enumerate(['{"symbol":"a","risk_score":90}', '{"symbol":"a","risk_score":90}\n{"symbol":"b","risk_score":10}', '{"symbol":"b","risk_score":10}']):
        (tmp_path / "in" / f"{i}.json").write_text(rows)
        streams.alert_sink(source(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out" / f"batch_id={i}"))
        assert got.count() == [2, 1, 0][i]
        for part in (tmp_path / "out" / f"batch_id={i}").glob("part-*") if i == 0 else ():
            part.write_bytes(b"not a table")


def test_restart_continues(spark, feed):
    df, path, tmp = feed
    for _ in range(2):
        s = streams.ingest_stream(spark, path, df.schema).select(F.col("k").alias("symbol"), F.col("v").alias("risk_score"), F.lit("x").alias("risk_category"),
                                                                 F.array(F.lit("Sentiment")).alias("risk_factors"))
        streams.alert_sink(s, str(tmp / "alerts"), str(tmp / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp / "alerts"))
    assert got.where("severity = 'warning'").count() == 2 and got.where("severity = 'info'").count() == 6


def test_plans_push_filters_and_prune(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    from tidemark.operators.filters import lookup
    plan = lookup(orders, {"o_orderstatus": "F"}).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan
