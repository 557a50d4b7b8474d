"""Queries for the series operators (W) on daily bars and events."""

from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.plans.bindings import MARKET, NEWS, OHLC, PRIORITIES, market, news, ohlc, table
from tidemark.plans.registry import R, query, r, rounded

W = "WINDOW w AS (PARTITION BY symbol ORDER BY day)"
WITH = f"WITH {OHLC} "


def roll(fn: str, n: int, col: str = "close") -> str:
    frame = f"OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {frame} >= {n} THEN {fn}({col}) {frame} END"


@query("w_01_latest_per_key", "SELECT event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1")
def _(spark, d):
    return S.latest_per_key(table(spark, d, "events").select("event_type", "event_id", "ts", "value"), "event_type", "ts", tie=[F.col("event_id").desc()])


@query("w_02_last_n_per_key", "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def _(spark, d):
    return S.last_n_per_key(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", 3, tie=[F.col("event_id").desc()])


@query("w_03_sma", WITH + f"SELECT symbol, day, {R(roll('avg', 7))} AS sma_7, {R(roll('avg', 30))} AS sma_30 FROM ohlc")
def _(spark, d):
    df = S.sma(S.sma(ohlc(spark, d), "symbol", "day", "close", 7), "symbol", "day", "close", 30)
    return df.select("symbol", "day", r("sma_7"), r("sma_30"))


@query("w_04_partial_mean", WITH + f"SELECT symbol, day, {R('avg(close) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)')} AS sma_7 FROM ohlc")
def _(spark, d):
    return S.sma(ohlc(spark, d), "symbol", "day", "close", 7, min_periods=1).select("symbol", "day", r("sma_7"))


EWMA_SQL = """WITH RECURSIVE """ + OHLC + """,
seq AS (SELECT symbol, day, close, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i FROM ohlc),
rec AS (SELECT symbol, day, i, close AS a, close AS b, CAST(0.0 AS DOUBLE) AS s FROM seq WHERE i = 1
        UNION ALL
        SELECT q.symbol, q.day, q.i, q.close * (2.0 / 13) + rec.a * (11.0 / 13), q.close * (2.0 / 27) + rec.b * (25.0 / 27),
               ((q.close * (2.0 / 13) + rec.a * (11.0 / 13)) - (q.close * (2.0 / 27) + rec.b * (25.0 / 27))) * (2.0 / 10) + rec.s * (8.0 / 10)
        FROM rec JOIN seq q ON q.symbol = rec.symbol AND q.i = rec.i + 1)
"""


@query("w_05_ewma", EWMA_SQL + f"SELECT symbol, day, {R('a', 4)} AS ema_12, {R('b', 4)} AS ema_26 FROM rec")
def _(spark, d):
    df = S.ewma(ohlc(spark, d).select("symbol", "day", "close"), "symbol", "day", "close", {"ema_12": 12, "ema_26": 26})
    return df.select("symbol", "day", r("ema_12", 4), r("ema_26", 4))


@query("w_06_macd", EWMA_SQL + f"SELECT symbol, day, {R('a - b', 4)} AS macd, {R('s', 4)} AS macd_signal, {R('a - b - s', 4)} AS macd_hist FROM rec")
def _(spark, d):
    df = S.macd(ohlc(spark, d).select("symbol", "day", "close"), "symbol", "day", "close")
    return df.select("symbol", "day", r("macd", 4), r("macd_signal", 4), r("macd_hist", 4))


@query("w_07_rsi", WITH + f""", m AS (SELECT symbol, day, close - lag(close) OVER (PARTITION BY symbol ORDER BY day) AS dlt FROM ohlc),
g AS (SELECT symbol, day, CASE WHEN dlt > 0 THEN dlt ELSE 0 END AS up, CASE WHEN dlt < 0 THEN -dlt ELSE 0 END AS down FROM m),
a AS (SELECT symbol, day, count(*) OVER f AS n, avg(up) OVER f AS u, avg(down) OVER f AS l FROM g
      WINDOW f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
SELECT symbol, day, CASE WHEN n >= 14 THEN {R('100 - 100 / (1 + u / CASE WHEN l = 0 THEN 1e-5 ELSE l END)')} END AS rsi_14 FROM a""".replace(" , m", ", m"))
def _(spark, d):
    return S.rsi(ohlc(spark, d), "symbol", "day", "close").select("symbol", "day", r("rsi_14"))


@query("w_08_bollinger", WITH + f""", b AS (SELECT symbol, day, close, {roll('avg', 20)} AS m, {roll('stddev_samp', 20)} AS s FROM ohlc)
SELECT symbol, day, {R('m')} AS bb_middle, {R('m + 2 * s', 4)} AS bb_upper, {R('m - 2 * s', 4)} AS bb_lower, {R('4 * s / m')} AS bb_width,
       {R('(close - (m - 2 * s)) / (4 * s)')} AS bb_position FROM b""")
def _(spark, d):
    df = S.bollinger(ohlc(spark, d), "symbol", "day", "close")
    return df.select("symbol", "day", r("bb_middle"), r("bb_upper", 4), r("bb_lower", 4), r("bb_width"), r("bb_position"))


@query("w_09_rolling_std", WITH + f"SELECT symbol, day, {R(roll('stddev_samp', 14), 4)} AS std_14 FROM ohlc")
def _(spark, d):
    return S.rolling_std(ohlc(spark, d), "symbol", "day", "close", 14).select("symbol", "day", r("std_14", 4))


@query("w_10_rate_of_change", WITH + f"SELECT symbol, day, {R('close / lag(close) OVER w - 1')} AS price_roc, {R('volume / lag(volume) OVER w - 1')} AS volume_roc FROM ohlc {W}")
def _(spark, d):
    df = S.pct_change(ohlc(spark, d), "symbol", "day", "close", out="price_roc")
    return S.pct_change(df, "symbol", "day", "volume", out="volume_roc").select("symbol", "day", r("price_roc"), r("volume_roc"))


@query("w_11_momentum", WITH + f""", m AS (SELECT symbol, day, close - lag(close, 5) OVER w AS m5 FROM ohlc {W})
SELECT symbol, day, {R('m5', 4)} AS momentum_5, {R('m5 - lag(m5) OVER (PARTITION BY symbol ORDER BY day)', 4)} AS acceleration_5 FROM m""")
def _(spark, d):
    return S.momentum(ohlc(spark, d), "symbol", "day", "close", 5).select("symbol", "day", r("momentum_5", 4), r("acceleration_5", 4))


@query("w_12_price_to_ma", WITH + f"SELECT symbol, day, {R('close / (' + roll('avg', 20) + ')')} AS price_to_ma_20 FROM ohlc")
def _(spark, d):
    return S.price_to_ma(ohlc(spark, d), "symbol", "day", "close", 20).select("symbol", "day", r("price_to_ma_20"))


@query("w_13_lags_and_lead", WITH + f"SELECT symbol, day, lag(close, 1) OVER w AS lag_1, lag(close, 7) OVER w AS lag_7, lead(close) OVER w AS lead_1 FROM ohlc {W}")
def _(spark, d):
    df = S.with_lags(ohlc(spark, d), "symbol", "day", "close", [1, 7])
    return S.with_lead(df, "symbol", "day", "close").select("symbol", "day", "lag_1", "lag_7", "lead_1")


@query("w_14_fill", WITH + """, h AS (SELECT symbol, day, CASE WHEN volume >= 2 THEN close END AS x FROM ohlc)
SELECT symbol, day, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS x,
       first_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x_back FROM h""")
def _(spark, d):
    holes = ohlc(spark, d).select("symbol", "day", F.when(F.col("volume") >= 2, F.col("close")).alias("x")).withColumn("x_back", F.col("x"))
    return S.fill(S.fill(holes, "symbol", "day", ["x"], "ffill", then_zero=True), "symbol", "day", ["x_back"], "bfill")


@query("w_15_drawdown", WITH + f""", c AS (SELECT symbol, day, close / first_value(close) OVER w AS cum, row_number() OVER w AS i FROM ohlc {W}),
m AS (SELECT symbol, day, cum, i, max(CASE WHEN i > 1 THEN cum END) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS mx FROM c)
SELECT symbol, day, {R('cum')} AS cumulative, {R('mx')} AS running_max, {R('CASE WHEN i > 1 THEN cum / mx - 1 END')} AS drawdown FROM m""")
def _(spark, d):
    return S.drawdown(ohlc(spark, d), "symbol", "day", "close").select("symbol", "day", r("cumulative"), r("running_max"), r("drawdown"))


@query("w_16_volatility", WITH + f""", l AS (SELECT symbol, day, close, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS age FROM ohlc),
q AS (SELECT symbol, age, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS x FROM l WHERE age <= 90)
SELECT symbol, {R('stddev_samp(x) * 100')} AS daily_volatility, {R('stddev_samp(x) * sqrt(252) * 100')} AS annual_volatility,
 {R('stddev_samp(x) FILTER (age <= 7) * 100')} AS volatility_7, {R('stddev_samp(x) FILTER (age <= 30) * 100')} AS volatility_30,
 {R('max(x) * 100')} AS best_day, {R('min(x) * 100')} AS worst_day, count(x) AS n_returns FROM q GROUP BY symbol""")
def _(spark, d):
    df = S.volatility(ohlc(spark, d), "symbol", "day", "close")
    return rounded(df, "daily_volatility", "annual_volatility", "volatility_7", "volatility_30", "best_day", "worst_day")


@query("w_17_price_stats", WITH + f""", x AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS rt FROM ohlc)
SELECT symbol, arg_min(close, day) AS start_price, arg_max(close, day) AS last_price, max(close) AS highest, min(close) AS lowest, {R('avg(close)', 4)} AS average,
 count(*) AS n, {R('stddev_pop(rt) * 100')} AS volatility, {R('(arg_max(close, day) / arg_min(close, day) - 1) * 100')} AS change_pct FROM x GROUP BY symbol""")
def _(spark, d):
    return rounded(rounded(S.price_stats(ohlc(spark, d), "symbol", "day", "close"), "volatility", "change_pct"), "average", digits=4)


@query("w_18_period_performance", WITH + f""", p(period, start_at) AS (VALUES ('1m', DATE '2001-07-02'), ('3m', DATE '2001-05-03'), ('6m', DATE '2001-02-02'),
 ('1y', DATE '2000-08-01'), ('ytd', DATE '2001-01-01')),
x AS (SELECT symbol, period, arg_min(close, day) FILTER (day >= start_at) AS start_price, arg_max(close, day) AS last_price FROM ohlc, p GROUP BY 1, 2)
SELECT symbol, period, start_price, last_price, {R('(last_price / start_price - 1) * 100')} AS change_pct FROM x""")
def _(spark, d):
    as_of = F.lit("2001-08-01").cast("timestamp")
    return rounded(S.period_performance(ohlc(spark, d), "symbol", "day", "close", as_of), "change_pct")


@query("w_19_high_low_drawdown", WITH + f"""SELECT symbol, max(close) AS all_time_high, min(close) AS all_time_low, arg_max(close, day) AS last_price,
 arg_min(day, (-close, day)) AS high_at, arg_min(day, (close, day)) AS low_at, count(*) AS n,
 {R('(arg_max(close, day) / max(close) - 1) * 100')} AS current_drawdown_pct FROM ohlc GROUP BY symbol HAVING count(*) >= 30""")
def _(spark, d):
    return rounded(S.high_low_drawdown(ohlc(spark, d), "symbol", "day", "close"), "current_drawdown_pct")


@query("w_20_pair_correlation", WITH + f"""SELECT a.symbol AS key_a, b.symbol AS key_b, {R('corr(a.close, b.close)')} AS correlation, count(*) AS n_common,
 CASE WHEN corr(a.close, b.close) > 0.8 THEN 'High' WHEN corr(a.close, b.close) < 0.2 THEN 'Low' ELSE 'Medium' END AS level
 FROM ohlc a JOIN ohlc b ON a.day = b.day AND a.symbol < b.symbol GROUP BY 1, 2 HAVING count(*) >= 30""")
def _(spark, d):
    return rounded(S.pair_correlation(ohlc(spark, d), "symbol", "day", "close", PRIORITIES), "correlation")


@query("w_21_rebase", WITH + f""", x AS (SELECT symbol, day, close, row_number() OVER w - 1 AS i, first_value(close) OVER w AS p0, count(*) OVER (PARTITION BY symbol) AS n FROM ohlc {W})
SELECT symbol, day, {R('(close / p0 - 1) * 100')} AS change_pct FROM x WHERE i % greatest(1, n // 30) = 0""")
def _(spark, d):
    return rounded(S.rebase(ohlc(spark, d), "symbol", "day", "close"), "change_pct")


@query("w_22_top_performers", WITH + f"""SELECT symbol, arg_min(close, day) AS first_value, arg_max(close, day) AS last_value,
 {R('arg_max(close, day) - arg_min(close, day)')} AS change FROM ohlc GROUP BY symbol ORDER BY abs(arg_max(close, day) - arg_min(close, day)) DESC, symbol LIMIT 3""")
def _(spark, d):
    return rounded(S.top_performers(ohlc(spark, d), "symbol", "day", "close", 3), "change")


@query("w_23_half_trend", f"""WITH {NEWS}, x AS (SELECT symbol, score, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM news),
y AS (SELECT symbol, avg(score) FILTER (i < n // 2) AS a, avg(score) FILTER (i >= n // 2) AS b FROM x GROUP BY symbol)
SELECT symbol, {R('a')} AS first_half, {R('b')} AS second_half, {R('b - a')} AS trend, CASE WHEN b - a > 0.005 THEN 'improving' WHEN b - a < -0.005 THEN 'declining' ELSE 'stable' END AS label FROM y""")
def _(spark, d):
    return rounded(S.half_trend(news(spark, d), "symbol", "ts", "score", 0.005, tie=[F.col("event_id")]), "first_half", "second_half", "trend")


@query("w_24_recent_vs_previous", f"""WITH {NEWS}, x AS (SELECT CAST(ts AS DATE) AS day, avg(score) AS m FROM news GROUP BY 1),
y AS (SELECT m, row_number() OVER (ORDER BY day DESC) AS i FROM x),
z AS (SELECT avg(m) FILTER (i <= 7) AS a, avg(m) FILTER (i > 7 AND i <= 14) AS b FROM y)
SELECT {R('a')} AS recent, {R('b')} AS previous, {R('a - b')} AS change, CASE WHEN a - b > 0.05 THEN 'improving' WHEN a - b < -0.05 THEN 'declining' ELSE 'stable' END AS label FROM z""")
def _(spark, d):
    return rounded(S.recent_vs_previous(news(spark, d), "ts", "score"), "recent", "previous", "change")


@query("w_25_direction_changes", f"""WITH {MARKET}, x AS (SELECT symbol, price_change_24h > 0 AS up, lag(price_change_24h > 0) OVER (PARTITION BY symbol ORDER BY day) AS was FROM market)
SELECT symbol, count(*) FILTER (was IS NOT NULL AND was <> up) AS direction_changes, count(*) AS n FROM x GROUP BY symbol""")
def _(spark, d):
    return S.direction_changes(market(spark, d), "symbol", "day", "price_change_24h")


@query("w_26_gaps", """WITH x AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS gap_end FROM orders),
y AS (SELECT o_custkey, lag(gap_end) OVER (PARTITION BY o_custkey ORDER BY gap_end) AS gap_start, gap_end FROM x)
SELECT o_custkey, gap_start, gap_end, CAST(gap_end - gap_start AS BIGINT) AS gap_days FROM y WHERE gap_end - gap_start > 200""")
def _(spark, d):
    return S.gaps(table(spark, d, "orders").select("o_custkey", "o_orderdate"), "o_custkey", "o_orderdate", 200)


@query("w_27_gap_stats", f"""WITH x AS (SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS g FROM events)
SELECT event_type, count(*) AS n, {R('avg(g) / 1e6', 3)} AS avg_gap_seconds, {R('max(g) / 1e6', 6)} AS max_gap_seconds FROM x GROUP BY 1""")
def _(spark, d):
    return rounded(S.gap_stats(table(spark, d, "events").select("event_type", "ts"), "event_type", "ts"), "max_gap_seconds").withColumn("avg_gap_seconds", r(F.col("avg_gap_seconds"), 3))


@query("w_28_bursts", f"""WITH x AS (SELECT event_type, ts, (epoch_us(lead(ts, 4) OVER (PARTITION BY event_type ORDER BY ts)) - epoch_us(ts)) / 1e6 AS s FROM events)
SELECT event_type, ts AS burst_start, {R('s', 6)} AS span_seconds FROM x WHERE s < 3600""")
def _(spark, d):
    return rounded(S.bursts(table(spark, d, "events").select("event_type", "ts"), "event_type", "ts"), "span_seconds")


@query("w_29_calendar", "SELECT event_id, CAST((dayofweek(ts) + 6) % 7 AS INTEGER) AS day_of_week, CAST(month(ts) AS INTEGER) AS month, CAST(quarter(ts) AS INTEGER) AS quarter FROM events")
def _(spark, d):
    return S.calendar(table(spark, d, "events").select("event_id", "ts"), "ts").drop("ts")


@query("w_30_zscore", f"SELECT o_orderkey, {R('(o_totalprice - avg(o_totalprice) OVER p) / stddev_samp(o_totalprice) OVER p')} AS zscore FROM orders WINDOW p AS (PARTITION BY o_orderpriority)")
def _(spark, d):
    return S.zscore(table(spark, d, "orders"), "o_orderpriority", "o_totalprice").select("o_orderkey", r("zscore"))


@query("w_31_training_windows", WITH + f""", x AS (SELECT symbol, day, list(close) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS f,
 list(close) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS t FROM ohlc)
SELECT symbol, day, f[1] AS first_feature, f[10] AS last_feature, t[1] AS first_target, t[3] AS last_target FROM x WHERE len(f) = 10 AND len(t) = 3""")
def _(spark, d):
    df = S.training_windows(ohlc(spark, d), "symbol", "day", "close", 10, 3)
    return df.select("symbol", "day", F.col("features")[0].alias("first_feature"), F.col("features")[9].alias("last_feature"),
                     F.col("targets")[0].alias("first_target"), F.col("targets")[2].alias("last_target"))


@query("w_32_context_features", WITH + f""", x AS (SELECT symbol, day, count(*) OVER (PARTITION BY symbol ORDER BY day ROWS 29 PRECEDING) AS n, {R(roll('avg', 7), 4)} AS mean_7, {R(roll('avg', 14), 4)} AS mean_14,
 {R(roll('avg', 30), 4)} AS mean_30, {R(roll('stddev_pop', 7), 4)} AS std_7, {R(roll('stddev_pop', 14), 4)} AS std_14,
 {R('close - lag(close, 29) OVER (PARTITION BY symbol ORDER BY day)', 4)} AS momentum FROM ohlc)
SELECT symbol, day, mean_7, mean_14, mean_30, std_7, std_14, momentum FROM x WHERE n = 30""")
def _(spark, d):
    df = S.context_features(ohlc(spark, d), "symbol", "day", "close")
    cols = ["mean_7", "mean_14", "mean_30", "std_7", "std_14", "momentum"]
    return df.select("symbol", "day", *[r(c, 4) for c in cols])


@query("w_33_time_split", WITH + """, x AS (SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ohlc)
SELECT symbol, day, CASE WHEN i < floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM x""")
def _(spark, d):
    return S.time_split(ohlc(spark, d).select("symbol", "day"), "symbol", "day")


@query("w_34_synth_open", WITH + f"""SELECT symbol, day, coalesce(CASE WHEN volume >= 2 THEN open END, lag(close) OVER w, close) AS open, close FROM ohlc {W}""")
def _(spark, d):
    holes = ohlc(spark, d).select("symbol", "day", F.when(F.col("volume") >= 2, F.col("open")).alias("open"), "close")
    return S.synth_open(holes, "symbol", "day")


@query("w_35_ohlc_bars", f"""SELECT event_type, date_trunc('hour', ts) AS bar_start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
 {R('sum(value)', 2)} AS volume, count(*) AS ticks FROM events GROUP BY 1, 2""")
def _(spark, d):
    return rounded(S.ohlc_bars(table(spark, d, "events"), "event_type", "ts", "value", "value", "1h", tie="event_id"), "volume", digits=2)


@query("w_35_weekly_bars", f"""SELECT event_type, date_trunc('week', ts) AS bar_start, arg_min(value, (ts, event_id)) AS open, arg_max(value, (ts, event_id)) AS close, count(*) AS ticks FROM events GROUP BY 1, 2""")
def _(spark, d):
    return S.ohlc_bars(table(spark, d, "events"), "event_type", "ts", "value", None, "1w", tie="event_id").select("event_type", "bar_start", "open", "close", "ticks")


@query("w_36_minmax", "SELECT event_id, round((value - min(value) OVER p) / (max(value) OVER p - min(value) OVER p), 3) AS scaled FROM events WINDOW p AS (PARTITION BY event_type)")
def _(spark, d):
    return S.minmax(table(spark, d, "events"), "value", "event_type", out="scaled").select("event_id", "scaled")


@query("w_37_split_series", f"""WITH x AS (SELECT event_type, event_id, CASE WHEN count(*) OVER f >= 20 THEN avg(value) OVER f END AS m FROM events
 WINDOW f AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT event_type, event_id, {R('m')} AS sma_20 FROM x""")
def _(spark, d):
    ticks = table(spark, d, "events").select("event_type", "event_id", "ts", "value")
    return S.sma(ticks, "event_type", "ts", "value", 20, split=100).select("event_type", "event_id", r("sma_20"))


@query("w_37_split_macd", f"""WITH t AS (SELECT event_type, ts, avg(value) AS x FROM events GROUP BY 1, 2), s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM t),
 m AS (SELECT a.event_type, a.ts, a.i, sum(b.x * CASE WHEN b.i = 1 THEN pow(11.0 / 13, a.i - 1) ELSE 2.0 / 13 * pow(11.0 / 13, a.i - b.i) END) - sum(b.x * CASE WHEN b.i = 1 THEN pow(25.0 / 27, a.i - 1) ELSE 2.0 / 27 * pow(25.0 / 27, a.i - b.i) END) AS macd
       FROM s a JOIN s b ON a.event_type = b.event_type AND b.i <= a.i GROUP BY 1, 2, 3)
 SELECT a.event_type, a.ts, {R('any_value(a.macd)', 4)} AS macd, {R('sum(b.macd * CASE WHEN b.i = 1 THEN pow(0.8, a.i - 1) ELSE 0.2 * pow(0.8, a.i - b.i) END)', 4)} AS macd_signal
 FROM m a JOIN m b ON a.event_type = b.event_type AND b.i <= a.i GROUP BY 1, 2""")
def _(spark, d):
    """Blocks far smaller than the series, against the sums that the averages stand for."""
    ticks = table(spark, d, "events").groupBy("event_type", "ts").agg(F.avg("value").alias("value"))
    return S.macd(ticks, "event_type", "ts", "value", split=1000).select("event_type", "ts", r("macd", 4), r("macd_signal", 4))
