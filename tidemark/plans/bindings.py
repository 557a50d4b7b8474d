"""How the operators' inputs are read from the bundled tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.operators import series

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- daily price bars: one row per order priority and day -------------------------------------
def ohlc(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey")
    bars = series.ohlc_bars(orders, "o_orderpriority", "o_orderdate", "o_totalprice", None, "1d", tie="o_orderkey")
    return bars.select(F.col("o_orderpriority").alias("symbol"), F.to_date("bar_start").alias("day"), "open", "high", "low", "close", "volume")


OHLC = """ohlc AS (
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day,
         arg_min(o_totalprice, (epoch(o_orderdate), o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
         arg_max(o_totalprice, (epoch(o_orderdate), o_orderkey)) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2)"""


# ---- market snapshots: the bars seen as price, cap, volume and 24 h change --------------------
def market(spark: SparkSession, d: str) -> DataFrame:
    return ohlc(spark, d).select(
        "symbol", "day", F.col("close").alias("price"), (F.col("high") * 1000).alias("market_cap"),
        (F.col("volume") * F.col("close")).alias("volume_24h"),
        ((F.col("close") - F.col("open")) / F.col("open") * 100).alias("price_change_24h"))


MARKET = OHLC + """, market AS (
  SELECT symbol, day, close AS price, high * 1000 AS market_cap, volume * close AS volume_24h,
         (close - open) / open * 100 AS price_change_24h FROM ohlc)"""


# ---- scored news: events with a score in 0..1 and a label --------------------------------------
def news(spark: SparkSession, d: str) -> DataFrame:
    score = F.least(F.lit(1.0), F.col("value") / 200)
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("symbol"), "ts", score.alias("score")).withColumn(
        "label", F.when(F.col("score") > 0.6, "POSITIVE").when(F.col("score") < 0.2, "NEGATIVE").otherwise("NEUTRAL"))


NEWS = """news AS (
  SELECT event_id, event_type AS symbol, ts, least(1.0, value / 200) AS score,
         CASE WHEN least(1.0, value / 200) > 0.6 THEN 'POSITIVE' WHEN least(1.0, value / 200) < 0.2 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label
  FROM events)"""


# ---- transactions: order lines seen as transfers from customers to suppliers --------------------
def txs(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, d, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate", "l_returnflag", "l_linestatus", "l_tax")
    # Order lines and orders meet on the order key, which no customer or supplier can dominate.
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("tx_id"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("sender"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("recipient"),
        F.col("l_extendedprice").alias("value"), F.col("l_shipdate").alias("ts"), F.col("l_returnflag").alias("token"),
        F.when(F.col("l_linestatus") == "F", "1").otherwise("0").alias("is_error"), F.col("l_tax").alias("gas_price"),
        F.when(F.col("l_linenumber") % 3 == 0, "0x").when(F.col("l_linenumber") % 3 == 1, "0xa9059cbb00")
        .otherwise("0x38ed173900").alias("input"))


TXS = """txs AS (
  SELECT l_orderkey || '-' || l_linenumber AS tx_id, 'c' || o_custkey AS sender, 's' || l_suppkey AS recipient, l_extendedprice AS value,
         l_shipdate AS ts, l_returnflag AS token, CASE WHEN l_linestatus = 'F' THEN '1' ELSE '0' END AS is_error, l_tax AS gas_price,
         CASE l_linenumber % 3 WHEN 0 THEN '0x' WHEN 1 THEN '0xa9059cbb00' ELSE '0x38ed173900' END AS input
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


# ---- wallets: customers with what their orders say about them -----------------------------------
def wallets(spark: SparkSession, d: str) -> DataFrame:
    cust = table(spark, d, "customer")
    acts = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("transaction_count"), F.min("o_orderdate").alias("first_activity"), F.max("o_orderdate").alias("last_activity"),
        F.count_distinct("o_orderdate").alias("active_days"), F.count_if(F.col("o_orderstatus") == "F").alias("contract_interactions"))
    k = F.col("c_custkey")
    features = F.array_compact(F.array(
        F.when(k % 2 == 0, "Multi-sig (2-of-3)").when(k % 7 == 1, "Multi-sig"), F.when(k % 3 == 0, "Hardware Security"),
        F.when(k % 5 == 0, "Time-locked"), F.when(k % 11 == 0, "Daily limits")))
    factors = F.array_compact(F.array(F.when(F.col("c_acctbal") < 0, "Negative balance"), F.when(k % 4 == 0, "New counterparty"),
                                      F.when(F.col("transaction_count") < 5, "Very few transactions")))
    joined = cust.join(acts, cust.c_custkey == acts.o_custkey, "left")
    count = F.coalesce("transaction_count", F.lit(0))
    return joined.select(
        F.concat(F.lit("0x"), F.lpad(F.hex(k), 40, "0")).alias("address"), F.col("c_custkey").alias("wallet_id"), F.col("c_mktsegment").alias("fund"),
        F.col("c_acctbal").alias("balance"), count.alias("transaction_count"), "first_activity", "last_activity",
        F.coalesce("active_days", F.lit(0)).alias("active_days"), F.coalesce("contract_interactions", F.lit(0)).alias("contract_interactions"),
        F.element_at(F.array(*[F.lit(x) for x in ("Cold Storage", "Hot Wallet", "Treasury", "General")]), (F.col("c_nationkey") % 4 + 1).cast("int")).alias("wallet_type"),
        features.alias("security_features"), factors.alias("risk_factors"),
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), (F.col("c_acctbal") + 1000) / 110)).alias("risk_score"))


WALLETS = """acts AS (
  SELECT o_custkey, count(*) AS transaction_count, min(o_orderdate) AS first_activity, max(o_orderdate) AS last_activity,
         count(DISTINCT o_orderdate) AS active_days, count(*) FILTER (o_orderstatus = 'F') AS contract_interactions
  FROM orders GROUP BY 1),
wallets AS (
  SELECT '0x' || lpad(to_hex(c_custkey), 40, '0') AS address, c_custkey AS wallet_id, c_mktsegment AS fund, c_acctbal AS balance,
         coalesce(transaction_count, 0) AS transaction_count, first_activity, last_activity, coalesce(active_days, 0) AS active_days,
         coalesce(contract_interactions, 0) AS contract_interactions,
         CASE c_nationkey % 4 WHEN 0 THEN 'Cold Storage' WHEN 1 THEN 'Hot Wallet' WHEN 2 THEN 'Treasury' ELSE 'General' END AS wallet_type,
         list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'Multi-sig (2-of-3)' WHEN c_custkey % 7 = 1 THEN 'Multi-sig' END,
           CASE WHEN c_custkey % 3 = 0 THEN 'Hardware Security' END, CASE WHEN c_custkey % 5 = 0 THEN 'Time-locked' END,
           CASE WHEN c_custkey % 11 = 0 THEN 'Daily limits' END], lambda x: x IS NOT NULL) AS security_features,
         list_filter([CASE WHEN c_acctbal < 0 THEN 'Negative balance' END, CASE WHEN c_custkey % 4 = 0 THEN 'New counterparty' END,
           CASE WHEN transaction_count < 5 THEN 'Very few transactions' END], lambda x: x IS NOT NULL) AS risk_factors,
         least(100.0, greatest(0.0, (c_acctbal + 1000) / 110)) AS risk_score
  FROM customer LEFT JOIN acts ON c_custkey = o_custkey)"""


# ---- holdings: each supplier's sales split over part brands --------------------------------------
def holdings(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    items = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice")
    sums = items.join(parts, items.l_partkey == parts.p_partkey).groupBy(
        F.col("l_suppkey").alias("fund"), F.col("p_brand").alias("asset")).agg(F.sum("l_extendedprice").alias("amount"))
    return scale.with_totals(sums, "fund", {"_t": F.sum("amount")}).withColumn("allocation", F.col("amount") / F.col("_t")).drop("_t")


HOLDINGS = """holdings AS (
  SELECT fund, asset, amount, amount / sum(amount) OVER (PARTITION BY fund) AS allocation
  FROM (SELECT l_suppkey AS fund, p_brand AS asset, sum(l_extendedprice) AS amount
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))"""
