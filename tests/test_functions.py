"""Hand-computed cases of the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, ladders, numbers, symbols, texts


def values(spark, rows, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_parse_number(spark):
    rows = ["1.69K", "-", "12%", "91,867.5", "9.27M", "$3B", "n/a", None, "about 7 units", "1d", "2.5e3", "", "-4.5", "€1T", "."]
    want = [1690.0, 0.0, 12.0, 91867.5, 9270000.0, 3e9, 0.0, 0.0, 7.0, 1.0, 2500.0, 0.0, -4.5, 1e12, 0.0]
    assert values(spark, rows, numbers.parse_number) == pytest.approx(want)


def test_parse_rating_and_fraction(spark):
    assert values(spark, ["7/10", "70%", "4", "8", "85", "poor"], numbers.parse_rating10) == pytest.approx([7, 7, 8, 8, 8.5, 5])
    assert values(spark, ["20%", "0.3", "15", "none"], numbers.parse_fraction) == [0.2, 0.3, 0.15, None]


def test_aum_and_amount(spark):
    assert values(spark, ["$120 million", "2.5 billion", "5000000"], numbers.parse_aum_millions) == pytest.approx([120, 2500, 5])
    assert values(spark, ["$1.5M", "3K", "2B", "17"], numbers.parse_amount) == pytest.approx([1.5e6, 3e3, 2e9, 17])


def test_wei_keeps_large_amounts(spark):
    assert values(spark, ["1500000000000000000", "oops"], numbers.wei_to_eth) == [1.5, None]


def test_formats(spark):
    assert values(spark, [1234567.0, -5.0, None], numbers.fmt_currency, "double") == ["$1,234,567.00", "-$5.00", "N/A"]
    assert values(spark, [0.1234], lambda c: numbers.fmt_percent(c, 1, True), "double") == ["12.3%"]


def test_dates(spark):
    rows = ["2023-01-15", "2023-01-15 14:30:45", "15.01.2023", "Jan 15, 2023", "20230115", "since 2019", "03/06/2025", "31/12/2024", "nothing"]
    got = [x and x.isoformat() for x in values(spark, rows, dates.parse_date_any)]
    assert got == ["2023-01-15T00:00:00", "2023-01-15T14:30:45", "2023-01-15T00:00:00", "2023-01-15T00:00:00", "2023-01-15T00:00:00", "2019-01-01T00:00:00",
                   "2025-03-06T00:00:00", "2024-12-31T00:00:00", None]
    assert values(spark, [1700000000, 1700000000000], dates.epoch_auto, "long") == [dt.datetime(2023, 11, 14, 22, 13, 20)] * 2


def test_ladder_boundaries(spark):
    assert values(spark, [19.9, 20.0, 40.0, 60.0, 80.0, None], ladders.five_level, "double") == ["Very Low", "Low", "Moderate", "High", "Very High", "Undetermined"]
    assert values(spark, [29.9, 30.0, 70.0], ladders.three_level, "double") == ["Low", "Medium", "High"]
    assert values(spark, [85.0, 84.9, 50.0, 30.0, 1.0], ladders.compliance_level, "double") == ["High", "Substantial", "Moderate", "Partial", "Low"]


def test_symbols(spark):
    assert values(spark, ["Bitcoin", "btcusdt", "ETH/USD", "USDT"], lambda c: symbols.norm_symbol(c, "base")) == ["BTC", "BTC", "ETH", "USDT"]
    assert [tuple(x) for x in values(spark, ["BTCUSD", "ETHBTC", "ADAEUR", "XRP"], symbols.split_pair)] == [("BTC", "USD"), ("ETH", "BTC"), ("ADA", "EUR"), ("XRP", "USD")]
    assert values(spark, ["0x", "0xa9059cbb1", "0x12", None], symbols.tx_category) == ["transfer", "erc20_transfer", "contract_interaction", "transfer"]
    assert values(spark, ["Case v. State", "Annual Report", "x"], symbols.doc_type_from_name) == ["legal_case", "financial_analysis", None]


def test_term_counts_by_mode(spark):
    rows = ["The method of ETH: eth, Eth!"]
    assert values(spark, rows, lambda c: texts.term_count(texts.prepared(c), "eth")) == [4]
    assert values(spark, rows, lambda c: texts.term_count(texts.prepared(c, "word"), "eth", "word")) == [3]
    assert values(spark, ["a smart contract; smart-contract smart contracts"], lambda c: texts.term_count(texts.prepared(c, "word"), "smart contract", "word")) == [2]


def test_sentences(spark):
    assert values(spark, ["One. Two!\n Three? tail", "no end", "", None], texts.sentences) == [["One.", "Two!", "Three?"], ["no end"], [], []]


def test_truncate(spark):
    assert values(spark, ["alpha beta gamma", "short"], lambda c: texts.truncate_words(c, 10)) == ["alpha...", "short"]
