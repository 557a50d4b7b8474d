"""Queries for sources and sinks (S), scalar functions (F), forecasts (M), data quality (Q), streams (X) and model hooks (U)."""


import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import dates, ladders, numbers, records, symbols, texts
from tidemark.operators import forecast as M
from tidemark.operators import models as U
from tidemark.operators import quality as Q
from tidemark.operators import scoring, series
from tidemark.plans.bindings import MARKET, NEWS, OHLC, WALLETS, holdings, market, news, ohlc, table, wallets
from tidemark.plans.registry import R, query, r, rounded
from tidemark.session import scratch_dir
from tidemark.sources import files, tables
from tidemark.streaming import streams


# ------------------------------------------------------------------------- sources and sinks
@query("s_01_read_ohlcv_csv", f"WITH {OHLC} SELECT upper(replace(symbol, '-', '')) AS name, CAST(day AS TIMESTAMP) AS timestamp, CAST(round(close, 2) AS DOUBLE) AS close, CAST(round(high, 2) AS DOUBLE) AS high, volume FROM ohlc")
def _(spark, d):
    """Bars are exported as messy CSV (quoted numbers with separators, US dates) and read back."""
    out = scratch_dir(spark, "ohlcv")
    text = ohlc(spark, d).select("symbol", F.date_format("day", "MM/dd/yyyy").alias("Date"), *[F.format_number(c, 2).alias(n) for c, n in (("close", "Price"), ("open", "Open"), ("high", "High"), ("low", "Low"))],
                                 F.concat(F.col("volume").cast("int"), F.lit("")).alias("Vol."), F.lit("0.1%").alias("Change %"))
    text.write.partitionBy("symbol").option("header", True).option("quoteAll", True).csv(out)
    df = files.read_ohlcv_csv(spark, f"{out}/*/*.csv")
    name = F.upper(F.regexp_replace(F.regexp_extract("file", "symbol=([^/]+)/", 1), "-", ""))
    return df.select(name.alias("name"), "timestamp", "close", "high", "volume")


@query("s_02_detect_date_format", "SELECT o_orderpriority AS file, CASE o_orderpriority WHEN '1-URGENT' THEN 'yyyy-M-d' WHEN '2-HIGH' THEN 'd/M/yyyy' WHEN '3-MEDIUM' THEN 'M/d/yyyy' WHEN '5-LOW' THEN 'unix' ELSE 'yyyyMMdd' END AS date_format, count(*) AS n, min(CASE WHEN o_orderpriority = '5-LOW' THEN o_orderdate + to_seconds(1000000000) ELSE o_orderdate END) AS first FROM orders GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("file"), "o_orderdate")
    t = F.col("o_orderdate")
    text = (F.when(F.col("file") == "1-URGENT", F.date_format(t, "yyyy-MM-dd")).when(F.col("file") == "2-HIGH", F.date_format(t, "dd/MM/yyyy")).when(F.col("file") == "3-MEDIUM", F.date_format(t, "MM/dd/yyyy"))
            .when(F.col("file") == "5-LOW", (F.unix_timestamp(t.cast("timestamp")) + 1000000000).cast("string")).otherwise(F.date_format(t, "yyyyMMdd")))
    rows = o.select("file", text.alias("text"))
    found = files.detect_date_format(rows, "text", "file")
    parsed = rows.join(found, "file").withColumn("ts", files.parse_detected(F.col("text"), F.col("date_format")))
    return parsed.groupBy("file", "date_format").agg(F.count("ts").alias("n"), F.min("ts").alias("first"))


@query("s_03_symbol_and_exchange", """WITH f AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'BTC_USD Kraken ' WHEN 1 THEN 'Ethereum Futures CME ' ELSE 'SOLUSDT ' END || p_name || '.csv' AS file FROM part)
 SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'BTCUSD' WHEN 1 THEN 'ETHUSD' ELSE 'SOLUSDT' END AS symbol, CASE p_partkey % 3 WHEN 0 THEN 'Kraken' WHEN 1 THEN 'CME' ELSE 'Unknown Exchange' END AS exchange FROM f""")
def _(spark, d):
    k = F.col("p_partkey") % 3
    start = F.when(k == 0, "BTC_USD Kraken ").when(k == 1, "Ethereum Futures CME ").otherwise("SOLUSDT ")
    df = table(spark, d, "part").select("p_partkey", F.concat(start, F.lit("part "), F.col("p_partkey").cast("string"), F.lit(".csv")).alias("file"))
    return files.with_exchange(files.with_symbol(df)).select("p_partkey", "symbol", "exchange")


@query("s_04_read_articles", "SELECT CAST(page_id AS VARCHAR) AS id, url, html AS content, TIMESTAMP '2024-01-01' + to_seconds(page_id) AS date, 1 AS n_authors FROM pages")
def _(spark, d):
    out = scratch_dir(spark, "articles")
    p = table(spark, d, "pages")
    stamp = (F.lit(1704067200000) + F.col("page_id") * 1000).cast("string")
    p.select(F.col("page_id").cast("string").alias("id"), "url", F.col("html").alias("content"), stamp.alias("date"), F.array(F.lit("desk")).alias("authors")).write.json(out)
    return files.read_articles(spark, out, multi_line=False).select("id", "url", "content", "date", F.size("authors").alias("n_authors"))


@query("s_05_read_corpus", "SELECT 'part' AS kind, CAST(sum(length(text)) + count(*) AS BIGINT) AS chars, count(*) AS n FROM (SELECT replace(replace(text, chr(10), ' '), chr(13), ' ') AS text FROM documents)")
def _(spark, d):
    """Documents are written as text files of bounded size and read back whole, one row per file."""
    out = scratch_dir(spark, "corpus")
    docs = table(spark, d, "documents").select(F.regexp_replace("text", "[\r\n]", " ").alias("text"))
    docs.write.option("maxRecordsPerFile", 200).text(out)
    corpus = files.read_corpus(spark, out)
    return corpus.groupBy(F.substring("file_name", 1, 4).alias("kind")).agg(F.sum(F.length("text")).alias("chars"), F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("n"))


HTML = r"""CASE WHEN regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) <> '' THEN regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) ELSE html END"""
for _tag in ("script", "style", "nav", "header", "footer", "title"):
    HTML = f"regexp_replace({HTML}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', ' ', 'g')"
HTML = f"regexp_replace(regexp_replace({HTML}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


def _unescape(x):
    for a, b in files.ENTITIES:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query("s_06_html_to_text", f"SELECT page_id, {_unescape(TITLE)} AS title, {_unescape(HTML)} AS text FROM pages")
def _(spark, d):
    return files.html_to_text(table(spark, d, "pages").select("page_id", "html"), "html").drop("html")


@query("s_07_flatten", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS p_k, event_type AS p_kind_name, value AS list_0_v, value * 2 AS list_1_v, CASE WHEN event_id % 3 = 0 THEN '[{"v":' || event_id || '.0},{"v":7.0}]' END AS list_rest, CAST(to_json([event_type, 'x']) AS VARCHAR) AS tags FROM events""")
def _(spark, d):
    e, third = table(spark, d, "events"), F.col("event_id") % 3 == 0
    nested = e.select("event_id", F.struct(F.from_json("props", "k int")["k"].alias("k"), F.struct(F.col("event_type").alias("name")).alias("kind")).alias("p"),
                      F.filter(F.array(F.struct(F.col("value").alias("v")), F.struct((F.col("value") * 2).alias("v")), F.when(third, F.struct(F.col("event_id").cast("double").alias("v"))), F.when(third, F.struct(F.lit(7.0).alias("v")))), lambda x: x.isNotNull()).alias("list"), F.array("event_type", F.lit("x")).alias("tags"))
    return files.flatten(nested, positions=2)


@query("s_08_candles_to_ohlcv", "SELECT o_orderkey, o_orderdate AS timestamp, o_totalprice AS open, o_totalprice AS high, o_totalprice AS low, o_totalprice AS close, 5.0::DOUBLE AS volume FROM orders WHERE o_orderkey % 10 <> 0")
def _(spark, d):
    price = F.when(F.col("o_orderkey") % 10 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    ms = (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 1000).cast("string")
    rows = table(spark, d, "orders").select("o_orderkey", F.array(ms, price, price, price, price, F.lit("5.0")).alias("candle"))
    return files.candles_to_ohlcv(rows, "candle", ["o_orderkey"])


@query("s_09_first_available", "SELECT c_custkey AS k, 'first' AS src FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'second' FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return files.first_available(c.where("k % 3 = 0").withColumn("src", F.lit("first")), c.where("k % 2 = 0").withColumn("src", F.lit("second")), ["k"])


@query("s_10_normalize_ticker", "SELECT 'ok' AS kind, upper(event_type) AS symbol, value AS price, 0::BIGINT AS rejected FROM events WHERE event_id % 2 = 0 AND event_id % 7 <> 0 UNION ALL SELECT 'rejects', NULL, NULL, count(*) FILTER (event_id % 7 = 0) FROM events WHERE event_id % 2 = 0")
def _(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 2 == 0, "main").otherwise("other").alias("source"), F.concat(F.lit(" "), "event_type").alias("ticker"),
                                         F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.col("value").cast("string")).alias("price"))
    good, counts = files.normalize_ticker(e, source="main")
    return good.select(F.lit("ok").alias("kind"), "symbol", "price", F.lit(0).cast("long").alias("rejected")).unionByName(
        counts.select(F.lit("rejects").alias("kind"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("double").alias("price"), "rejected"))


@query("s_11_splice", f"""WITH {OHLC}, f AS (SELECT symbol, min(day) AS f FROM ohlc WHERE day >= DATE '2001-01-15' GROUP BY 1), u AS (SELECT symbol, day, 'old' AS src FROM ohlc JOIN f USING (symbol) WHERE day < DATE '2001-06-01' AND day < f.f UNION ALL SELECT symbol, day, 'new' FROM ohlc WHERE day >= DATE '2001-01-15')
 SELECT symbol, day, src FROM u QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY day DESC) <= 300""")
def _(spark, d):
    b = ohlc(spark, d).select("symbol", "day")
    old = b.where("day < DATE '2001-06-01'").withColumn("src", F.lit("old"))
    return files.splice(old, b.where("day >= DATE '2001-01-15'").withColumn("src", F.lit("new")), "symbol", "day", 300)


@query("s_12_write_table", "SELECT event_type AS symbol, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE value END AS price, ts FROM events WHERE event_id % 11 <> 0")
def _(spark, d):
    out = scratch_dir(spark, "market")
    e = table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.when(F.col("event_id") % 11 == 0, "oops").when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.col("value").cast("string")).alias("price"), "ts")
    tables.write_table(e, out, {"symbol": "string", "price": "double", "ts": "timestamp_ntz"}, defaults={"price": 0.0}, required=["symbol"], partition_by=["symbol"])
    return spark.read.schema("price double, ts timestamp_ntz, symbol string").parquet(out).select("symbol", "price", "ts")


@query("s_13_load_new", "SELECT 'row' AS kind, o_custkey AS k, count(*) AS n FROM orders WHERE o_custkey % 2 = 1 GROUP BY 1, 2 UNION ALL SELECT CASE WHEN o_custkey % 2 = 1 THEN 'success' ELSE 'skipped' END, count(DISTINCT o_custkey), count(*) FROM orders GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    fresh, summary = tables.load_new(o, o.where("o_custkey % 2 = 0"), "o_custkey")
    rows = fresh.groupBy(F.lit("row").alias("kind"), F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(summary.select(F.col("outcome").alias("kind"), F.col("keys").alias("k"), F.col("n_rows").alias("n")))


@query("s_14_upsert_and_delete", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS version, CASE WHEN doc_id % 5 = 1 THEN 'done' ELSE 'open' END AS processing_status FROM documents WHERE doc_id % 4 <> 3")
def _(spark, d):
    base = table(spark, d, "documents").select("doc_id", F.lit("old").alias("version"), F.lit(1).alias("at"), F.lit("open").alias("processing_status"))
    changed = base.where("doc_id % 3 = 0").withColumn("version", F.lit("new")).withColumn("at", F.lit(2))
    out = tables.delete_keys(tables.upsert(base, changed, "doc_id", "at"), base.where("doc_id % 4 = 3").select("doc_id"), ["doc_id"])
    return tables.set_status(out, base.where("doc_id % 5 = 1"), "doc_id", "done").drop("at")


@query("s_15_summarize_nested", f"WITH {WALLETS} SELECT wallet_id, len(security_features)::INTEGER AS security_features_count, CASE WHEN transaction_count >= active_days THEN 'tx' ELSE 'days' END AS activity_top FROM wallets")
def _(spark, d):
    out = scratch_dir(spark, "summary")
    w = wallets(spark, d).select("wallet_id", "security_features", F.create_map(F.lit("tx"), F.col("transaction_count"), F.lit("days"), F.col("active_days")).alias("activity"))
    tables.export_csv(w, out)
    return spark.read.option("header", True).schema("wallet_id bigint, security_features_count int, activity_top string").csv(out)


@query("s_16_snapshot", "(SELECT 'orders' AS table_name, '{\"o_orderkey\":' || o_orderkey || '}' AS record FROM orders ORDER BY o_orderkey DESC LIMIT 7) UNION ALL (SELECT 'events', '{\"event_id\":' || event_id || '}' FROM events ORDER BY event_id DESC LIMIT 7)")
def _(spark, d):
    o, e = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "events").select("event_id")
    return tables.snapshot({"orders": (o, [F.col("o_orderkey").desc()]), "events": (e, [F.col("event_id").desc()])}, 7)


# -------------------------------------------------------------------------- scalar functions
@query("f_01_parse_number", """SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN l_quantity * 1000 WHEN 2 THEN l_quantity * 1000000 WHEN 3 THEN l_quantity WHEN 4 THEN 0.0 WHEN 5 THEN l_quantity ELSE l_quantity * 1000 + 0.5 END AS x FROM lineitem""")
def _(spark, d):
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    text = (F.when(n == 1, F.concat(q, F.lit("K"))).when(n == 2, F.concat(F.lit("$"), q, F.lit(".0M"))).when(n == 3, F.concat(q, F.lit("%"))).when(n == 4, "-").when(n == 5, F.concat(F.lit("about "), q, F.lit(" units")))
            .otherwise(F.concat(q, F.lit(",000.5"))))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.parse_number(text).alias("x"))


@query("f_02_parse_fraction", f"SELECT p_partkey, {R('CASE p_partkey % 3 WHEN 0 THEN p_size / 100 WHEN 1 THEN CASE WHEN p_size <= 1 THEN p_size ELSE p_size / 100 END ELSE p_size / 100 END')} AS x FROM part")
def _(spark, d):
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("fee "), s, F.lit("%"))).when(k == 1, s).otherwise(F.concat(F.lit("0."), F.lpad(s, 2, "0")))
    return table(spark, d, "part").select("p_partkey", r(numbers.parse_fraction(text)).alias("x"))


@query("f_03_parse_aum", f"SELECT s_suppkey, {R('CASE s_suppkey % 3 WHEN 0 THEN s_suppkey WHEN 1 THEN s_suppkey * 1000 ELSE s_suppkey / 1000000 END')} AS x FROM supplier")
def _(spark, d):
    s, k = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 3
    text = F.when(k == 0, F.concat(F.lit("$"), s, F.lit(" Million"))).when(k == 1, F.concat(s, F.lit(" billion"))).otherwise(s)
    return table(spark, d, "supplier").select("s_suppkey", r(numbers.parse_aum_millions(text)).alias("x"))


@query("f_04_parse_amount", "SELECT s_suppkey, CAST(CASE s_suppkey % 4 WHEN 0 THEN s_suppkey * 1000000000 WHEN 1 THEN s_suppkey * 1000000 WHEN 2 THEN s_suppkey * 1000 ELSE s_suppkey END AS DOUBLE) AS x FROM supplier")
def _(spark, d):
    s, k = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 4
    text = F.when(k == 0, F.concat(F.lit("$"), s, F.lit("B"))).when(k == 1, F.concat(s, F.lit(" million"))).when(k == 2, F.concat(s, F.lit("k"))).otherwise(s)
    return table(spark, d, "supplier").select("s_suppkey", numbers.parse_amount(text).alias("x"))


@query("f_05_parse_rating", f"SELECT p_partkey, {R('CASE p_partkey % 3 WHEN 0 THEN p_size / 50 * 10 WHEN 1 THEN p_size / 10 ELSE CASE WHEN p_size <= 5.5 THEN p_size * 2 WHEN p_size > 10 THEN p_size / 10 ELSE p_size END END')} AS x FROM part")
def _(spark, d):
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(s, F.lit("/50"))).when(k == 1, F.concat(s, F.lit("%"))).otherwise(s)
    return table(spark, d, "part").select("p_partkey", r(numbers.parse_rating10(text)).alias("x"))


@query("f_06_parse_date_any", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN date_trunc('year', o_orderdate) ELSE o_orderdate END::TIMESTAMP AS x FROM orders")
def _(spark, d):
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = (F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.date_format(t, "MMM d, yyyy")).when(k == 2, F.date_format(t, "d MMM yyyy")).when(k == 3, F.date_format(t, "yyyy/MM/dd"))
            .otherwise(F.concat(F.lit("sometime in "), F.date_format(t, "yyyy"))))
    return table(spark, d, "orders").select("o_orderkey", dates.parse_date_any(text).alias("x"))


@query("f_07_epoch_and_rfc3339", "SELECT o_orderkey, o_orderdate AS x, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders")
def _(spark, d):
    s = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    stamp = F.when((F.col("o_orderkey") % 2 == 0) & (s > 1000000000), s * 1000).otherwise(s)
    df = table(spark, d, "orders").select("o_orderkey", dates.epoch_auto(stamp).alias("x"))
    return df.withColumn("iso", dates.to_rfc3339("x"))


@query("f_08_format", "SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 'N/A' ELSE '$' || CAST(s_suppkey % 900 + 1 AS VARCHAR) || '.00M' END AS cur, CAST(s_nationkey AS VARCHAR) || '.0%' AS pct FROM supplier")
def _(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", numbers.fmt_currency(F.when(k % 9 != 0, (k % 900 + 1) * 1000000.0), short=True).alias("cur"), numbers.fmt_percent(F.col("s_nationkey"), 1).alias("pct"))


@query("f_09_symbols", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH' ELSE 'SOL' END AS base, CASE p_partkey % 3 WHEN 0 THEN 'BTCUSDT' WHEN 1 THEN 'ETHUSDT' ELSE 'SOLUSDT' END AS pair, CASE p_partkey % 3 WHEN 0 THEN 'BTC_USDT' WHEN 1 THEN 'ETH_USDT' ELSE 'SOL_USDT' END AS stored,
 CASE p_partkey % 3 WHEN 0 THEN 'BIT' WHEN 1 THEN 'ETH' ELSE 'SOL' END AS left_part, CASE p_partkey % 3 WHEN 0 THEN 'OIN' WHEN 1 THEN 'USDT' ELSE 'USD' END AS right_part FROM part""")
def _(spark, d):
    k = F.col("p_partkey") % 3
    s = F.when(k == 0, "Bitcoin").when(k == 1, "ethusdt").otherwise("SOLUSD")
    df = table(spark, d, "part").select("p_partkey", symbols.norm_symbol(s, "base").alias("base"), symbols.norm_symbol(s).alias("pair"), symbols.norm_symbol(s, "storage").alias("stored"), symbols.split_pair(s).alias("p"))
    left = F.when(F.col("p.quote") == "OIN", F.substring("p.base", 1, 3)).otherwise(F.col("p.base"))
    return df.select("p_partkey", "base", "pair", "stored", left.alias("left_part"), F.col("p.quote").alias("right_part"))


@query("f_10_units", f"SELECT o_orderkey, {R('o_totalprice')} AS eth, {R('o_totalprice')} AS tokens FROM orders")
def _(spark, d):
    cents = F.round(F.col("o_totalprice") * 100).cast("decimal(20,0)")
    wei = F.concat(cents.cast("string"), F.repeat(F.lit("0"), F.lit(16)))
    units = F.concat(cents.cast("string"), F.lit("0000"))
    return table(spark, d, "orders").select("o_orderkey", r(numbers.wei_to_eth(wei)).alias("eth"), r(numbers.token_units(units, F.lit(6))).alias("tokens"))


@query("f_11_addresses", "SELECT c_custkey, c_custkey % 2 = 0 AS ok, lower(a) AS norm, substr(a, 1, 6) || '...' || right(a, 4) AS short FROM (SELECT c_custkey, '0x' || lpad(to_hex(c_custkey), CASE WHEN c_custkey % 2 = 0 THEN 40 ELSE 39 END, 'A') AS a FROM customer)")
def _(spark, d):
    k = F.col("c_custkey")
    a = F.concat(F.lit("0x"), F.when(k % 2 == 0, F.lpad(F.hex(k), 40, "A")).otherwise(F.lpad(F.hex(k), 39, "A")))
    return table(spark, d, "customer").select("c_custkey", symbols.is_eth_address(a).alias("ok"), symbols.norm_address(F.concat(F.lit(" "), a)).alias("norm"), symbols.short_address(a).alias("short"))


@query("f_12_tx_category", "SELECT CASE l_linenumber % 3 WHEN 0 THEN 'transfer' WHEN 1 THEN 'erc20_transfer' ELSE 'contract_interaction' END AS kind, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    k = F.col("l_linenumber") % 3
    data = F.when(k == 0, "0x").when(k == 1, "0xa9059cbb00").otherwise("0x38ed173900")
    return table(spark, d, "lineitem").groupBy(symbols.tx_category(data).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("f_13_normalize_allocations", f"""WITH h AS (SELECT l_suppkey AS fund, p_brand AS asset, count(*) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), t AS (SELECT *, c / sum(c) OVER (PARTITION BY fund) AS s FROM h)
 SELECT fund, asset, {R('s')} AS allocation FROM t""")
def _(spark, d):
    from tidemark import scale
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    h = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("fund"), F.col("p_brand").alias("asset")).agg(F.count(F.lit(1)).alias("c"))
    share = scale.with_totals(h, "fund", {"_t": F.sum("c")})
    # Every third fund states percentages, every other third shares that only sum to one half.
    stated = F.when(F.col("fund") % 3 == 0, F.col("c") / F.col("_t")).when(F.col("fund") % 3 == 1, F.col("c") / F.col("_t") * 100).otherwise(F.col("c") / F.col("_t") / 2)
    df = scoring.normalize_allocations(share.select("fund", "asset", stated.alias("allocation")))
    return rounded(df, "allocation")


@query("f_14_text_trim", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' AS blank, CASE WHEN length(text) <= 60 THEN text ELSE regexp_replace(substr(text, 1, 60), ' [^ ]*\\z', '') || '...' END AS cut FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", (texts.squeeze("text") == "").alias("blank"), texts.truncate_words("text", 60).alias("cut"))


@query("f_15_bucketize", f"""WITH {WALLETS} SELECT wallet_id, CASE WHEN risk_score < 20 THEN 'Very Low' WHEN risk_score < 40 THEN 'Low' WHEN risk_score < 60 THEN 'Moderate' WHEN risk_score < 80 THEN 'High' ELSE 'Very High' END AS five, CASE WHEN risk_score < 30 THEN 'Low' WHEN risk_score < 70 THEN 'Medium' ELSE 'High' END AS three,
 CASE WHEN risk_score / 10 < 3 THEN 'Very Low' WHEN risk_score / 10 < 5 THEN 'Low' WHEN risk_score / 10 < 7 THEN 'Medium' WHEN risk_score / 10 < 9 THEN 'High' ELSE 'Very High' END AS component, CASE WHEN risk_score >= 85 THEN 'High' WHEN risk_score >= 70 THEN 'Substantial' WHEN risk_score >= 50 THEN 'Moderate' WHEN risk_score >= 30 THEN 'Partial' ELSE 'Low' END AS compliance FROM wallets""")
def _(spark, d):
    return wallets(spark, d).select("wallet_id", ladders.five_level("risk_score").alias("five"), ladders.three_level("risk_score").alias("three"), ladders.component_level(F.col("risk_score") / 10).alias("component"), ladders.compliance_level("risk_score").alias("compliance"))


@query("f_16_clamp", "SELECT c_custkey, least(5000.0, greatest(0.0, c_acctbal)) AS x FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", numbers.clamp("c_acctbal", 0, 5000).alias("x"))


@query("f_17_record_round_trip", f"WITH {WALLETS} SELECT wallet_id, balance, array_to_string(security_features, '|') AS features FROM wallets")
def _(spark, d):
    w = wallets(spark, d).select("wallet_id", "balance", "security_features")
    back = records.from_record(records.to_record(w), w.schema)
    return back.select("wallet_id", "balance", F.array_join("security_features", "|").alias("features"))


@query("f_18_sanitize", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS price, 1 AS n_values, CAST(NULL AS INTEGER) AS missing FROM events")
def _(spark, d):
    raw = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.col("value").cast("string")).alias("price"), F.array(F.lit("bad"), F.lit("1.5")).alias("vals"))
    out = records.sanitize(raw, {"price": "double", "vals": "array<double>", "missing": "int"})
    return out.select("event_id", "price", F.size("vals").alias("n_values"), "missing")


@query("f_19_doc_types", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'whitepaper' WHEN 1 THEN 'legal_case' WHEN 2 THEN 'risk_assessment' END AS kind, CASE doc_id % 4 WHEN 0 THEN 'whitepaper' WHEN 1 THEN 'regulatory_filing' WHEN 2 THEN 'due_diligence_report' ELSE 'project_documentation' END AS stored FROM documents")
def _(spark, d):
    k = F.col("doc_id") % 4
    name = F.when(k == 0, "My-WhitePaper.pdf").when(k == 1, "court-file.txt").when(k == 2, "threat assessment.doc").otherwise("notes.txt")
    df = table(spark, d, "documents").select("doc_id", symbols.doc_type_from_name(name).alias("kind"))
    return df.withColumn("stored", symbols.map_type(F.coalesce("kind", F.lit("other"))))


# ------------------------------------------------------------------------------------ forecasts
WMA = f"""WITH {OHLC}, a AS (SELECT symbol, day, close, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS age, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS x FROM ohlc),
 m AS (SELECT symbol, avg(close) FILTER (age <= 7) * 0.5 + avg(close) FILTER (age <= 14) * 0.3 + avg(close) FILTER (age <= 30) * 0.2 AS w, avg(x) FILTER (i >= 30) AS dr, max(day) AS last, arg_max(close, day) AS cur FROM a GROUP BY 1)"""


@query("m_01_forecast_wma", WMA + f" SELECT symbol, s::INTEGER AS step, last + s::INTEGER AS forecast_date, {R('greatest(0.01, w * (1 + dr * s))', 3)} AS forecast, {R('(greatest(0.01, w * (1 + dr * s)) / cur - 1) * 100', 4)} AS change_pct, {R('greatest(0.01, w * (1 + dr * s)) * (1 - s * 0.01)', 3)} AS lower FROM m, range(1, 8) t(s)")
def _(spark, d):
    df = M.forecast_wma(ohlc(spark, d), "symbol", "day", "close")
    return df.select("symbol", "step", "forecast_date", r("forecast", 3), r("change_pct", 4), r("lower", 3))


@query("m_02_forecast_trend", f"""WITH {OHLC}, a AS (SELECT symbol, day, close, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS age FROM ohlc), m AS (SELECT symbol, max(close) FILTER (age = 1) AS cur, max(close) FILTER (age = 8) AS old, max(day) AS last FROM a GROUP BY 1)
 SELECT symbol, s::INTEGER AS step, last + s::INTEGER AS forecast_date, {R('cur * (1 + (cur / old - 1) * s / 7)', 3)} AS forecast, {R('cur * (1 + (cur / old - 1) * s / 7) * (1 + 0.005 * s)', 3)} AS upper FROM m, range(1, 8) t(s)""")
def _(spark, d):
    return M.forecast_trend(ohlc(spark, d), "symbol", "day", "close").select("symbol", "step", "forecast_date", r("forecast", 3), r("upper", 3))


def _windows(spark, d):
    df = series.training_windows(ohlc(spark, d), "symbol", "day", "close", 10, 2)
    return series.time_split(df, "symbol", "day")


@query("m_03_fit_multistep")
def _(spark, d):
    w = _windows(spark, d)
    train, test = w.where("part = 'train'"), w.where("part = 'test'")
    out = None
    for kind in ("linear", "forest", "boosting"):
        p = M.predict_multistep(M.fit_multistep(train, kind, 2, trees=5, depth=4), test, keep=["symbol", "day"]).withColumn("model", F.lit(kind))
        out = p if out is None else out.unionByName(p)
    return rounded(out, "prediction", digits=3)


@query("m_03_linear_lag", f"""WITH {OHLC}, x AS (SELECT symbol, day, close, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS l FROM ohlc), t AS (SELECT regr_slope(close, l) AS a, regr_intercept(close, l) AS b FROM x WHERE l IS NOT NULL AND day < DATE '1999-01-01')
 SELECT symbol, day, 1 AS step, {R('a * l + b', 3)} AS prediction FROM x, t WHERE l IS NOT NULL AND day >= DATE '1999-01-01'""")
def _(spark, d):
    """The pipeline on one lag is plain least squares."""
    x = series.with_lags(ohlc(spark, d).select("symbol", "day", "close"), "symbol", "day", "close", [1]).where("lag_1 IS NOT NULL")
    x = x.select("symbol", "day", F.array("lag_1").alias("features"), F.array("close").alias("targets"))
    models = M.fit_multistep(x.where("day < DATE '1999-01-01'"), "linear", 1)
    return rounded(M.predict_multistep(models, x.where("day >= DATE '1999-01-01'"), keep=["symbol", "day"]), "prediction", digits=3)


TWO_STEPS = f"{OHLC}, x AS (SELECT symbol, day, lag(close) OVER w AS l, close AS y1, lead(close) OVER w AS y2 FROM ohlc WINDOW w AS (PARTITION BY symbol ORDER BY day)), ok AS (SELECT * FROM x WHERE l IS NOT NULL AND y2 IS NOT NULL), train AS (SELECT * FROM ok WHERE day < DATE '1999-01-01')"


def _two_steps(spark, d):
    """One lag, this close and the next: whole windows only."""
    from tidemark import scale
    rows = scale.over_rows(ohlc(spark, d).select("symbol", "day", "close"), "symbol", "day", lambda w: {"l": F.lag("close").over(w), "y2": F.lead("close").over(w)}, back=1, ahead=1)
    return rows.where("l IS NOT NULL AND y2 IS NOT NULL").select("symbol", "day", F.array("l").alias("features"), F.array("close", "y2").alias("targets"))


@query("m_03_linear_two_steps", f"""WITH {TWO_STEPS}, t AS (SELECT regr_slope(y1, l) AS a1, regr_intercept(y1, l) AS b1, regr_slope(y2, l) AS a2, regr_intercept(y2, l) AS b2 FROM train), p AS (SELECT * FROM ok, t WHERE day >= DATE '1999-01-01')
 SELECT symbol, day, 1 AS step, {R('a1 * l + b1', 3)} AS prediction FROM p UNION ALL SELECT symbol, day, 2, {R('a2 * l + b2', 3)} FROM p""")
def _(spark, d):
    x = _two_steps(spark, d)
    model = M.fit_multistep(x.where("day < DATE '1999-01-01'"), "linear", 2)
    return rounded(M.predict_multistep(model, x.where("day >= DATE '1999-01-01'"), keep=["symbol", "day"]), "prediction", digits=3)


@query("m_03_tree_error_bound", f"""WITH {TWO_STEPS}, m AS (SELECT avg(y1) AS m1, avg(y2) AS m2 FROM train), e AS (SELECT 1 AS step, abs(y1 - m1) AS e FROM ok, m WHERE day >= DATE '1999-01-01' UNION ALL SELECT 2, abs(y2 - m2) FROM ok, m WHERE day >= DATE '1999-01-01')
 SELECT model, step, count(*) AS n, {R('avg(e)', 3)} AS mae_of_mean, true AS bounded FROM e, (VALUES ('forest'), ('boosting')) k(model) GROUP BY model, step""")
def _(spark, d):
    """Trees are fitted by drawing, so they have no twin: their mean error may be at most a twentieth above that of the training mean."""
    x = _two_steps(spark, d)
    train, test = x.where("day < DATE '1999-01-01'"), x.where("day >= DATE '1999-01-01'")
    means = train.agg(F.struct(*[F.avg(F.col("targets")[i]).alias(f"m{i}") for i in range(2)])).scalar()
    actual = test.withColumn("_m", means).select("symbol", "day", F.posexplode("targets").alias("_i", "observed"), F.array("_m.m0", "_m.m1").alias("_m"))
    actual = actual.select("symbol", "day", (F.col("_i") + 1).alias("step"), "observed", F.get("_m", F.col("_i")).alias("mean"))
    out = None
    for kind in ("forest", "boosting"):
        p = M.predict_multistep(M.fit_multistep(train, kind, 2, trees=10, depth=4), test, keep=["symbol", "day"]).withColumn("model", F.lit(kind))
        out = p if out is None else out.unionByName(p)
    error = out.join(actual, ["symbol", "day", "step"]).groupBy("model", "step").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("observed") - F.col("mean"))).alias("mae_of_mean"), F.avg(F.abs(F.col("observed") - F.col("prediction"))).alias("_mae"))
    return error.select("model", "step", "n", r("mae_of_mean", 3), (F.col("_mae") <= F.col("mae_of_mean") * 1.05).alias("bounded"))


PREDS = f"{OHLC}, p AS (SELECT symbol, day, close AS observed, 'naive' AS model, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS prediction FROM ohlc UNION ALL SELECT symbol, day, close, 'mean', avg(close) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) FROM ohlc), q AS (SELECT * FROM p WHERE prediction IS NOT NULL)"


def _preds(spark, d):
    b = ohlc(spark, d).select("symbol", "day", "close")
    naive = series.with_lags(b, "symbol", "day", "close", [1]).select("symbol", "day", F.col("close").alias("observed"), F.lit("naive").alias("model"), F.col("lag_1").alias("prediction"))
    from tidemark import scale
    mean = scale.over_rows(b, "symbol", "day", lambda w: {"m": F.avg("close").over(w.rowsBetween(-5, -1))}, back=5).select("symbol", "day", F.col("close").alias("observed"), F.lit("mean").alias("model"), F.col("m").alias("prediction"))
    return naive.unionByName(mean).where("prediction IS NOT NULL")


@query("m_04_ensemble", f"WITH {PREDS}, e AS (SELECT model, 1 / (avg(abs(prediction - observed)) + 1e-10) AS w FROM q GROUP BY 1), n AS (SELECT model, w / sum(w) OVER () AS weight FROM e) SELECT symbol, day, {R('sum(prediction * weight)', 3)} AS blended, count(*) AS n_models FROM q JOIN n USING (model) GROUP BY 1, 2")
def _(spark, d):
    p = _preds(spark, d)
    errors = p.groupBy("model").agg(F.avg(F.abs(F.col("prediction") - F.col("observed"))).alias("mae"))
    return rounded(M.ensemble(p, errors, ["symbol", "day"]), "blended", digits=3)


@query("m_05_evaluate", f"WITH {PREDS} SELECT model, {R('avg(abs(prediction - observed))', 3)} AS mae, {R('sqrt(avg((prediction - observed) * (prediction - observed)))', 3)} AS rmse, {R('avg(abs((observed - prediction) / observed)) * 100', 4)} AS mape, count(*) AS n FROM q GROUP BY 1")
def _(spark, d):
    p = _preds(spark, d)
    pred = p.select("symbol", "day", "model", F.col("prediction").alias("predicted"))
    actual = ohlc(spark, d).select("symbol", "day", F.col("close").alias("observed"))
    df = M.evaluate(pred, actual, ["symbol", "day"], by=["model"])
    return rounded(df, "mae", "rmse", digits=3).withColumn("mape", r(F.col("mape"), 4))


SAMPLES = "s AS (SELECT event_type AS symbol, CAST(event_id % 7 AS BIGINT) + 1 AS step, value FROM events), c AS (SELECT event_type AS symbol, arg_max(value, (ts, event_id)) AS current FROM events GROUP BY 1)"


def _samples(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("symbol"), (F.col("event_id") % 7 + 1).alias("step"), "value")


QUANT = "SELECT symbol, step, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.5) AS md, quantile_cont(value, 0.9) AS hi FROM s GROUP BY 1, 2"


@query("m_06_insights", f"""WITH {SAMPLES}, q AS ({QUANT}), g AS (SELECT symbol, avg(CASE WHEN md <> 0 THEN (hi - lo) / md * 100 ELSE 0 END) AS u, arg_max(md, step) AS f FROM q GROUP BY 1), p AS (SELECT symbol, avg((value > current)::INT) * 100 AS pi FROM s JOIN c USING (symbol) WHERE step = 7 GROUP BY 1),
 z AS (SELECT symbol, u, f, current, pi, (f / current - 1) * 100 AS ch FROM g JOIN c USING (symbol) JOIN p USING (symbol))
 SELECT symbol, {R('u', 4)} AS avg_uncertainty, {R('f', 4)} AS final_forecast, current, {R('pi', 4)} AS prob_increase, {R('ch', 4)} AS change_pct, CASE WHEN ch > 5 THEN 'strongly bullish' WHEN ch > 1 THEN 'bullish' WHEN ch < -5 THEN 'strongly bearish' WHEN ch < -1 THEN 'bearish' ELSE 'neutral' END AS trend FROM z""")
def _(spark, d):
    cur = table(spark, d, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("current"))
    df = M.insights(_samples(spark, d), cur, key="symbol").drop("insight")
    return rounded(df, "avg_uncertainty", "final_forecast", "prob_increase", "change_pct", digits=4)


@query("m_07_bands", f"WITH {SAMPLES}, q AS ({QUANT}) SELECT symbol, step, {R('lo', 4)} AS low, {R('md', 4)} AS median, {R('hi', 4)} AS high FROM q")
def _(spark, d):
    return rounded(M.bands(_samples(spark, d), ["symbol", "step"], "value"), "low", "median", "high", digits=4)


@query("m_08_compare_forecasts", f"""WITH {MARKET}, f AS (SELECT symbol, day, price_change_24h AS ch, CASE WHEN price_change_24h > 5 THEN 'up' WHEN price_change_24h < -5 THEN 'down' ELSE 'flat' END AS trend FROM market WHERE day >= TIMESTAMP '2001-08-01' - INTERVAL 60 DAYS),
 m AS (SELECT symbol, trend, count(*) AS c FROM f GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, trend) = 1), x AS (SELECT symbol, ch > 0 AS up, lag(ch > 0) OVER (PARTITION BY symbol ORDER BY day) AS was FROM f), k AS (SELECT symbol, count(*) FILTER (was IS NOT NULL AND was <> up) AS direction_changes FROM x GROUP BY 1)
 SELECT symbol, count(*) AS n, {R('avg(ch)')} AS avg_change, any_value(m.trend) AS common_trend, any_value(direction_changes) AS direction_changes, {R('any_value(c) / count(*) * 100')} AS consistency_pct FROM f JOIN m USING (symbol) JOIN k USING (symbol) GROUP BY 1""")
def _(spark, d):
    ch = F.col("price_change_24h")
    fc = market(spark, d).withColumn("trend", F.when(ch > 5, "up").when(ch < -5, "down").otherwise("flat"))
    df = M.compare_forecasts(fc, key="symbol", ts="day", change="price_change_24h", trend="trend", days=60, as_of=F.lit("2001-08-01").cast("timestamp"))
    return rounded(df, "avg_change", "consistency_pct")


@query("m_09_chart_series", f"""WITH {OHLC}, h AS (SELECT symbol, day, close FROM ohlc), a AS (SELECT symbol, max(day) AS d, arg_max(close, day) AS c FROM h GROUP BY 1), f AS (SELECT symbol, d + s::INTEGER AS date, c * s AS fc, c * s * 0.9 AS lo, c * s * 1.1 AS hi FROM a, range(1, 4) t(s)),
 u AS (SELECT symbol, day AS date, close AS price, NULL::DOUBLE AS fc, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi FROM h UNION ALL SELECT symbol, date, NULL, fc, lo, hi FROM f)
 SELECT symbol, date, price, {R('fc', 3)} AS forecast, {R('min(least(price, lo, fc)) OVER (PARTITION BY symbol)', 3)} AS y_min, {R('max(greatest(price, hi, fc)) OVER (PARTITION BY symbol)', 3)} AS y_max FROM u""")
def _(spark, d):
    h = ohlc(spark, d)
    last = h.groupBy("symbol").agg(F.max("day").alias("d"), F.max_by("close", "day").alias("c"))
    steps = F.sequence(F.lit(1), F.lit(3))
    fc = last.select("symbol", F.transform(steps, lambda s: F.date_add("d", s)).alias("forecast_dates"), F.transform(steps, lambda s: F.col("c") * s).alias("forecast_values"),
                     F.transform(steps, lambda s: F.col("c") * s * 0.9).alias("lower_bounds"), F.transform(steps, lambda s: F.col("c") * s * 1.1).alias("upper_bounds"))
    df = M.chart_series(h, M.explode_forecast(fc, ["symbol"]), key="symbol", ts="day", val="close")
    return df.select("symbol", "date", "price", r("forecast", 3), r("y_min", 3), r("y_max", 3))


@query("m_10_winsorize", f"WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.01) AS a, quantile_cont(l_extendedprice, 0.99) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, {R('greatest(least(l_extendedprice, b + 3 * (b - a)), a - 3 * (b - a))', 3)} AS l_extendedprice FROM lineitem JOIN q USING (l_returnflag)")
def _(spark, d):
    df = M.winsorize(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice"), ["l_extendedprice"], "l_returnflag")
    return df.select("l_orderkey", "l_linenumber", r("l_extendedprice", 3))


@query("m_11_confidence", f"""WITH {SAMPLES}, q AS ({QUANT}), g AS (SELECT symbol, step, md, lo, hi, current, (hi - lo) / md * 4 AS u FROM q JOIN c USING (symbol)) SELECT symbol, step, CASE WHEN u <= 5 THEN 'High' WHEN u <= 10 THEN 'Medium' ELSE 'Low' END AS confidence, {R('hi', 4)} AS best_case, {R('lo', 4)} AS worst_case, {R('(md - current) / current * 100', 1)} AS change_vs_latest FROM g""")
def _(spark, d):
    cur = table(spark, d, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("current"))
    b = M.bands(_samples(spark, d), ["symbol", "step"], "value").join(cur, "symbol")
    b = b.withColumn("average_uncertainty", (F.col("high") - F.col("low")) / F.col("median") * 4).withColumn("trend", F.lit("neutral"))
    df = M.forecast_table(M.confidence(b).select("symbol", "step", "confidence", F.col("median").alias("forecast"), F.col("high").alias("upper"), F.col("low").alias("lower"), "current"))
    change = r((F.col("forecast") - F.col("current")) / F.col("current") * 100, 1)
    return df.select("symbol", "step", "confidence", r("best_case", 4), r("worst_case", 4), change.alias("change_vs_latest"))


# -------------------------------------------------------------------------------------- quality
CLEAN = f"""WITH {OHLC}, q AS (SELECT symbol, count(*) AS n, quantile_cont(close, 0.25) AS c1, quantile_cont(close, 0.5) AS c2, quantile_cont(close, 0.75) AS c3, quantile_cont(volume, 0.25) AS v1, quantile_cont(volume, 0.5) AS v2, quantile_cont(volume, 0.75) AS v3 FROM ohlc GROUP BY 1)"""


@query("q_01_clean_ohlcv", CLEAN + f" SELECT symbol, day, greatest(open, high, low, close) AS high, least(open, high, low, close) AS low, close, {R('least(volume, v2 + 10 * (v3 - v1))')} AS volume FROM ohlc JOIN q USING (symbol) WHERE close BETWEEN greatest(0, c2 - 3 * (c3 - c1)) AND c2 + 5 * (c3 - c1)")
def _(spark, d):
    return Q.clean_ohlcv(ohlc(spark, d), "symbol", "day").select("symbol", "day", "high", "low", "close", r("volume"))


@query("q_02_series_issues", """WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders), u AS (SELECT DISTINCT o_custkey, day FROM o), g AS (SELECT o_custkey, count(*) FILTER (gp > 7) AS g FROM (SELECT o_custkey, day - lag(day) OVER (PARTITION BY o_custkey ORDER BY day) AS gp FROM u) GROUP BY 1),
 s AS (SELECT o_custkey, count(*) AS n, min(day) AS a, max(day) AS b FROM o GROUP BY 1) SELECT o_custkey, array_to_string(list_filter([CASE WHEN n < 10 THEN 'limited data: ' || n END, CASE WHEN g > 0 THEN 'date gaps: ' || g END, CASE WHEN b - a < 30 THEN 'short period: ' || (b - a) END, CASE WHEN DATE '2001-08-01' - b > 30 THEN 'not recent: ' || (DATE '2001-08-01' - b) END], lambda x: x IS NOT NULL), '|') AS issues FROM s JOIN g USING (o_custkey)""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    df = Q.series_issues(o, "o_custkey", "day", F.lit("2001-08-01"), close="o_totalprice", volume="o_totalprice")
    return df.select("o_custkey", F.array_join("issues", "|").alias("issues"))


@query("q_03_completeness", "SELECT 'orders' AS table_name, count(*) AS n, CASE WHEN count(*) > 10000 THEN 'Excellent' WHEN count(*) > 5000 THEN 'Good' WHEN count(*) > 1000 THEN 'Fair' ELSE 'Poor' END AS grade FROM orders UNION ALL SELECT 'documents', count(*), CASE WHEN count(*) > 100000000 THEN 'Excellent' WHEN count(*) > 10000000 THEN 'Good' WHEN count(*) > 20 THEN 'Fair' ELSE 'Poor' END FROM documents")
def _(spark, d):
    return Q.completeness({"orders": table(spark, d, "orders"), "documents": table(spark, d, "documents")}, {"orders": (10000, 5000, 1000), "documents": (100000000, 10000000, 20)})


@query("q_04_table_issues", f"WITH {NEWS} SELECT 'duplicate keys' AS issue, count(*)::DOUBLE AS amount FROM (SELECT 1 FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1) HAVING count(*) > 0 UNION ALL SELECT 'stale', floor(epoch(TIMESTAMP '2002-01-01' - max(o_orderdate)) / 86400) FROM orders UNION ALL SELECT 'neutral share', {R("count(*) FILTER (label = 'NEUTRAL') / count(*) * 100")} FROM news")
def _(spark, d):
    df = Q.table_issues(table(spark, d, "orders"), "o_custkey", "o_orderdate", news(spark, d), "label", F.lit("2002-01-01"), neutral_pct=10)
    return rounded(df, "amount")


@query("q_05_coverage", "SELECT min(o_orderdate) AS first, max(o_orderdate) AS last, count(DISTINCT o_custkey) AS keys, count(*) AS n, date_diff('day', min(o_orderdate), max(o_orderdate)) AS span_days FROM orders")
def _(spark, d):
    return Q.coverage(table(spark, d, "orders"), "o_custkey", "o_orderdate")


@query("q_06_check_schemas", """SELECT 'orders' AS table_name, 'o_clerk' AS column_name, 'missing column' AS problem, count(*) AS n_failed FROM orders UNION ALL SELECT 'orders', 'o_orderkey', 'type bigint', 0
 UNION ALL SELECT 'orders', 'o_orderpriority', 'type string', count(*) FILTER (TRY_CAST(o_orderpriority AS INTEGER) IS NULL) FROM orders UNION ALL SELECT 'forecasts', NULL, 'missing table', NULL""")
def _(spark, d):
    want = T.StructType([T.StructField("o_orderkey", T.StringType()), T.StructField("o_custkey", T.LongType()), T.StructField("o_clerk", T.StringType()), T.StructField("o_orderpriority", T.IntegerType())])
    return Q.check_schemas({"orders": want, "forecasts": want}, {"orders": table(spark, d, "orders")})


@query("q_07_validate", """SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'Unnamed Fund' ELSE s_name END AS fund_name, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey::DOUBLE END AS aum, CASE WHEN s_suppkey % 7 <> 0 THEN 0.02 END::DOUBLE AS management_fee,
 array_to_string(list_filter([CASE WHEN s_suppkey % 5 = 0 THEN 'missing fund name' END, CASE WHEN s_suppkey % 7 = 0 THEN 'invalid management_fee' END, CASE WHEN s_suppkey % 3 = 0 THEN 'invalid aum' END], lambda x: x IS NOT NULL), '|') AS reasons FROM supplier""")
def _(spark, d):
    k = F.col("s_suppkey")
    raw = table(spark, d, "supplier").select("s_suppkey", F.when(k % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "s_name")).alias("fund_name"), F.when(k % 3 == 0, "n/a").otherwise(F.concat(k.cast("string"), F.lit(" million"))).alias("aum"),
                                             F.when(k % 7 == 0, "none").otherwise("2%").alias("management_fee"), F.lit("2020-01-05").alias("launch_date"))
    df = Q.validate(raw, "fund", fees=["management_fee"])
    return df.select("s_suppkey", "fund_name", "aum", "management_fee", F.array_join("reasons", "|").alias("reasons"))


@query("q_07_split_valid", f"WITH {WALLETS} SELECT wallet_id % 6 <> 0 AS ok, count(*) AS n, {R('sum(CASE WHEN balance >= 0 THEN balance END)', 2)} AS balance FROM wallets GROUP BY 1")
def _(spark, d):
    w = wallets(spark, d).withColumn("address", F.when(F.col("wallet_id") % 6 == 0, "0x12").otherwise(F.col("address")))
    good, bad = Q.split_valid(Q.validate(w, "wallet"))
    def total(df, ok):
        return df.agg(F.lit(ok).alias("ok"), F.count(F.lit(1)).alias("n"), r(F.sum("balance"), 2).alias("balance"))
    return total(good, True).unionByName(total(bad, False))


@query("q_08_result_warnings", """SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_suppkey % 2 = 0 THEN 'Fund Name' END, CASE WHEN s_acctbal <= 0 THEN 'AUM' END], lambda x: x IS NOT NULL), '|') AS missing_fields, array_to_string(list_filter([CASE WHEN s_nationkey < 10 THEN 'Low analysis confidence: ' || s_nationkey * 7 || '%' END, 'Single wallet concentration risk'], lambda x: x IS NOT NULL), '|') AS warnings,
 s_suppkey % 2 <> 0 AND s_acctbal > 0 AS is_valid FROM supplier""")
def _(spark, d):
    df = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 1, F.col("s_name")).alias("fund_name"), F.col("s_acctbal").alias("aum"), F.lit(1).alias("n_wallets"), (F.col("s_nationkey") * 7).alias("confidence"))
    out = Q.result_warnings(df)
    return out.select("s_suppkey", F.array_join("missing_fields", "|").alias("missing_fields"), F.array_join("warnings", "|").alias("warnings"), "is_valid")


@query("q_09_recommendations", "SELECT 'labels' AS table_name, count(*) AS n, 1000000000 AS minimum, 'Label more documents' AS recommendation FROM labels")
def _(spark, d):
    from tidemark.operators.aggregates import table_counts
    counts = table_counts({t: table(spark, d, t) for t in ("orders", "labels")})
    return Q.recommendations(counts, {"orders": (10, "Load more orders"), "labels": (1000000000, "Label more documents")})


# -------------------------------------------------------------------------------------- streams
def event_stream(spark, d):
    """The events table as a file stream."""
    schema = table(spark, d, "events").schema
    names = {"pathGlobFilter": "events.parquet"}
    df = streams.ingest_stream(spark, d, schema, options=names)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


@query("x_01_ingest_stream", f"SELECT event_type, count(*) AS n, {R('sum(value)', 2)} AS total FROM events GROUP BY 1")
def _(spark, d):
    got = streams.run_once(event_stream(spark, d), "ingest", mode="append")
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 2).alias("total"))


@query("x_02_dedupe_stream", "SELECT event_id, event_type, value FROM events")
def _(spark, d):
    s = event_stream(spark, d)
    doubled = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return streams.run_once(streams.dedupe_stream(doubled, "event_id", "ts"), "dedupe", mode="append").select("event_id", "event_type", "value")


@query("x_03_bars_stream", "SELECT event_type, time_bucket(INTERVAL 15 MINUTES, ts) AS bar_start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS ticks FROM events GROUP BY 1, 2")
def _(spark, d):
    return streams.run_once(streams.bars_stream(event_stream(spark, d), "event_type", "ts", "value", tie="event_id"), "bars")


@query("x_04_sliding_sentiment", f"""WITH {NEWS}, w AS (SELECT symbol, score, unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAYS, date_trunc('day', ts), INTERVAL 1 DAY)) AS window_start FROM news)
 SELECT window_start, symbol, {R('avg(score)')} AS mean, count(*) AS n, count(*) FILTER (score > 0.6) AS positive, count(*) FILTER (score < 0.4) AS negative FROM w GROUP BY 1, 2""")
def _(spark, d):
    s = event_stream(spark, d).select(F.col("event_type").alias("symbol"), "ts", F.least(F.lit(1.0), F.col("value") / 200).alias("score"))
    return rounded(streams.run_once(streams.sliding_sentiment(s, "ts", "score", by="symbol"), "sentiment"), "mean")


@query("x_05_latest_stream", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def _(spark, d):
    return streams.run_once(streams.latest_stream(event_stream(spark, d), "user_id", "ts", ["event_id", "value"]), "latest")


# In append mode a row comes out once the watermark has passed it; what is late for it is dropped, what is still open stays inside.
CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


@query("x_06_burst_stream", f"""WITH x AS (SELECT event_type, ts, lead(ts, 4) OVER (PARTITION BY event_type ORDER BY ts) AS later FROM events)
 SELECT event_type, ts AS burst_start, (epoch_us(later) - epoch_us(ts)) / 1e6 AS span_seconds FROM x WHERE epoch_us(later) - epoch_us(ts) < 3600000000 AND later <= {CLOSED}""")
def _(spark, d):
    return streams.run_once(streams.burst_stream(event_stream(spark, d), "event_type", "ts"), "bursts", mode="append")


@query("x_07_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS brk FROM events), s AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
 SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOURS AS session_end, count(*) AS n FROM s GROUP BY user_id, sid""")
def _(spark, d):
    return streams.run_once(streams.sessions(event_stream(spark, d), "user_id", "ts", "12 hours"), "sessions")


def arriving(spark, d):
    """The events as a stream of one file after the other in the order of their times; a last file brings two early days once more, far too late."""
    out = scratch_dir(spark, "arriving")
    e = table(spark, d, "events")
    day = F.dayofmonth("ts")
    for rows in (e.where(day <= 8), e.where((day > 8) & (day <= 16)), e.where((day > 16) & (day <= 24)), e.where(day > 24), e.where(day <= 2)):
        rows.coalesce(1).write.mode("append").parquet(out)
    s = streams.ingest_stream(spark, out, e.schema, files_per_trigger=1, options={"maxFileAge": "10000d"})
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query("x_03_bars_append", f"SELECT event_type, time_bucket(INTERVAL 15 MINUTES, ts) AS bar_start, arg_min(value, (ts, event_id)) AS open, arg_max(value, (ts, event_id)) AS close, count(*) AS ticks FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 15 MINUTES, ts) + INTERVAL 15 MINUTES <= {CLOSED}")
def _(spark, d):
    bars = streams.bars_stream(arriving(spark, d), "event_type", "ts", "value", tie="event_id").select("event_type", "bar_start", "open", "close", "ticks")
    return streams.run_once(bars, "bars-append", mode="append")


@query("x_04_sliding_append", f"""WITH w AS (SELECT event_type, value, unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAYS, date_trunc('day', ts), INTERVAL 1 DAY)) AS window_start FROM events)
 SELECT window_start, event_type, count(*) AS n FROM w GROUP BY 1, 2 HAVING window_start + INTERVAL 7 DAYS <= {CLOSED}""")
def _(spark, d):
    s = arriving(spark, d).withColumn("score", F.col("value") / 200)
    return streams.run_once(streams.sliding_sentiment(s, "ts", "score", by="event_type", delay="1 hour"), "sliding-append", mode="append").select("window_start", "event_type", "n")


@query("x_06_burst_append", f"""WITH x AS (SELECT event_type, ts, lead(ts, 2) OVER (PARTITION BY event_type ORDER BY ts) AS later FROM events)
 SELECT event_type, ts AS burst_start, (epoch_us(later) - epoch_us(ts)) / 1e6 AS span_seconds FROM x WHERE epoch_us(later) - epoch_us(ts) < 3600000000 AND later <= {CLOSED}""")
def _(spark, d):
    """Five files one after the other; the last one is far too late and changes nothing."""
    return streams.run_once(streams.burst_stream(arriving(spark, d), "event_type", "ts", k=3), "bursts-append", mode="append")


@query("x_08_alert_sink", "SELECT severity, count(*) AS n FROM (SELECT 'info' AS severity FROM events GROUP BY event_type, floor(value) UNION ALL SELECT 'high' FROM events WHERE floor(value) >= 80 GROUP BY event_type, floor(value)) GROUP BY 1")
def _(spark, d):
    out = scratch_dir(spark, "alerts")
    s = event_stream(spark, d).select(F.col("event_type").alias("symbol"), F.floor("value").cast("double").alias("risk_score"), F.lit("n/a").alias("risk_category"), F.array().cast("array<string>").alias("risk_factors"))
    streams.alert_sink(s, f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("x_09_late_rows", """WITH m AS (SELECT event_id % 4 AS b, max(ts) AS mx FROM events GROUP BY 1), l AS (SELECT event_id, event_id % 4 AS b, ts FROM events) SELECT CASE WHEN b > 0 AND ts < (SELECT max(mx) FROM m WHERE m.b < l.b) - INTERVAL 10 DAYS THEN 'late' ELSE 'on time' END AS side, count(*) AS n FROM l GROUP BY 1""")
def _(spark, d):
    """The events arrive in four files one after the other."""
    out = scratch_dir(spark, "late")
    e = table(spark, d, "events")
    for part in range(4):
        e.where(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(f"{out}/in")
    s = streams.ingest_stream(spark, f"{out}/in", e.schema, files_per_trigger=1, options={"maxFileAge": "10000d"})
    streams.divert_late(s, "ts", "10 DAYS", f"{out}/good", f"{out}/late", f"{out}/state").awaitTermination()
    a = spark.read.schema(e.schema).parquet(f"{out}/good").agg(F.lit("on time").alias("side"), F.count(F.lit(1)).alias("n"))
    return a.unionByName(spark.read.schema(e.schema).parquet(f"{out}/late").agg(F.lit("late").alias("side"), F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------------------------- model hooks
def length_model():
    """A stand-in for a sentiment model: a number from the text's length."""
    return lambda batch: [len(t) % 100 / 100 for t in batch]


def letter_model():
    """A stand-in for an encoder: letter counts."""
    return lambda batch: [[float(t.count("e")), float(t.count("a"))] for t in batch]


@query("u_01_score_text", "SELECT doc_id, length(text) % 100 / 100 AS score FROM documents")
def _(spark, d):
    return U.score_text(table(spark, d, "documents").select("doc_id", "text"), "text", length_model).drop("text")


@query("u_02_embed_text", "SELECT doc_id, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS e, CAST(length(text) - length(replace(text, 'a', '')) AS DOUBLE) AS a FROM documents")
def _(spark, d):
    df = U.embed_text(table(spark, d, "documents").select("doc_id", "text"), "text", letter_model)
    return df.select("doc_id", F.col("embedding")[0].cast("double").alias("e"), F.col("embedding")[1].cast("double").alias("a"))


def span_of(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "spread": [float(pdf["close"].max() - pdf["close"].min())], "n": [len(pdf)]})


@query("u_03_per_series", f"WITH {OHLC} SELECT symbol, {R('max(close) - min(close)')} AS spread, count(*) AS n FROM ohlc GROUP BY 1")
def _(spark, d):
    return rounded(U.per_series(ohlc(spark, d).select("symbol", "close"), "symbol", span_of, "symbol string, spread double, n long"), "spread")
