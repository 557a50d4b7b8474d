"""Queries for on-chain operators (C) and scores (R)."""

from pyspark.sql import functions as F

from tidemark import lexicons as L
from tidemark.operators import onchain as C
from tidemark.operators import scoring as S
from tidemark.operators import series
from tidemark.operators import text as T
from tidemark.plans.bindings import HOLDINGS, MARKET, NEWS, TXS, WALLETS, holdings, market, news, table, txs, wallets
from tidemark.plans.registry import R, query, r, rounded

FIVE = "CASE WHEN {0} < 20 THEN 'Very Low' WHEN {0} < 40 THEN 'Low' WHEN {0} < 60 THEN '{1}' WHEN {0} < 80 THEN 'High' ELSE 'Very High' END"
COMP = "CASE WHEN {0} < 3 THEN 'Very Low' WHEN {0} < 5 THEN 'Low' WHEN {0} < 7 THEN 'Medium' WHEN {0} < 9 THEN 'High' ELSE 'Very High' END"
THREE = "CASE WHEN {0} < 30 THEN 'Low' WHEN {0} < 70 THEN 'Medium' ELSE 'High' END"
CLAMP = "least(100.0, greatest(0.0, {0}))"
TEN = "least(10.0, greatest(0.0, {0}))"

PROFILE = TXS + """, rows AS (SELECT sender AS address, recipient AS partner, value, ts, input, token, false AS incoming, true AS own FROM txs WHERE sender <> recipient UNION ALL SELECT recipient, CASE WHEN sender <> recipient THEN sender END, value, ts, input, token, true, sender = recipient FROM txs),
 prof AS (SELECT address, count(*) AS n, sum(CASE WHEN incoming THEN value ELSE 0 END) AS rec, sum(CASE WHEN NOT incoming THEN value ELSE 0 END) AS sent, min(ts) AS a, max(ts) AS b, count(DISTINCT partner) AS partners,
   count(*) FILTER (own AND input <> '0x') AS calls, count(DISTINCT partner) FILTER (own AND input <> '0x') AS contracts, count(DISTINCT token) AS variety, epoch(max(ts) - min(ts)) / 86400 AS age FROM rows GROUP BY 1)"""


@query("c_01_wallet_profile", f"WITH {PROFILE} SELECT address, n AS transaction_count, {R('rec', 2)} AS total_received, {R('sent', 2)} AS total_sent, a AS first_activity, b AS last_activity, partners AS unique_interactions, calls AS contract_interactions, contracts AS unique_contracts, variety AS token_variety, {R('age')} AS age_days FROM prof")
def _(spark, d):
    t = txs(spark, d)
    df = C.wallet_profile(t, t.select("sender", "recipient", "token")).drop("token_transaction_count")
    return rounded(rounded(df, "total_received", "total_sent", digits=2), "age_days")


@query("c_02_wallet_risk", f"""WITH {PROFILE}, s AS (SELECT *, least(100, greatest(0, 50 + CASE WHEN age < 30 THEN 20 WHEN age < 180 THEN 10 WHEN age > 365 THEN -10 ELSE 0 END + CASE WHEN n < 5 THEN 15 WHEN n > 1000 THEN 5 ELSE 0 END
 + CASE WHEN contracts = 0 THEN -5 WHEN contracts > 20 THEN -10 ELSE 0 END + CASE WHEN partners < 3 THEN 15 WHEN partners > 50 THEN -10 ELSE 0 END + CASE WHEN variety > 10 THEN -5 ELSE 0 END))::DOUBLE AS sc FROM prof)
 SELECT address, sc AS risk_score, {FIVE.format('sc', 'Medium')} AS risk_level, array_to_string(list_filter([CASE WHEN age < 30 THEN 'Recently created wallet' END, CASE WHEN n < 5 THEN 'Very few transactions' END, CASE WHEN partners < 3 THEN 'Limited interaction network' END, CASE WHEN contracts = 0 THEN 'No interaction with smart contracts' END], lambda x: x IS NOT NULL), '|') AS factors FROM s""")
def _(spark, d):
    t = txs(spark, d)
    df = C.wallet_risk(C.wallet_profile(t, t.select("sender", "recipient", "token")))
    return df.select("address", "risk_score", "risk_level", F.array_join("risk_factors", "|").alias("factors"))


@query("c_03_tx_stats", f"""WITH {TXS} SELECT sender, count(*) AS n, {R('sum(value)', 2)} AS total_value, {R('avg(value)', 4)} AS average_value, max(value) AS max_value, {R("count(*) FILTER (is_error = '0') / count(*) * 100")} AS success_rate,
 count(*) FILTER (is_error <> '0') AS error_count, {R('avg(gas_price)')} AS avg_gas, min(ts) AS first_tx, max(ts) AS last_tx FROM txs GROUP BY 1""")
def _(spark, d):
    df = rounded(C.tx_stats(txs(spark, d), "sender"), "success_rate", "avg_gas")
    return df.withColumns({"total_value": r(F.col("total_value"), 2), "average_value": r(F.col("average_value"), 4)})


@query("c_04_tx_patterns", f"""WITH {TXS}, p AS (SELECT sender, recipient, count(*) AS k FROM txs GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY sender ORDER BY count(*) DESC, recipient) = 1)
 SELECT t.sender, {R("count(*) FILTER (input = '0x') / count(*) * 100")} AS transfer_pct, {R("count(*) FILTER (input <> '0x') / count(*) * 100")} AS contract_pct, any_value(p.recipient) AS top_recipient, any_value(k) AS top_count FROM txs t JOIN p USING (sender) GROUP BY 1""")
def _(spark, d):
    return rounded(C.tx_patterns(txs(spark, d), "sender"), "transfer_pct", "contract_pct")


@query("c_05_tx_risk_indicators", f"""WITH e AS (SELECT user_id, ts, value, CASE WHEN event_type = 'error' OR event_id % 4 = 0 THEN '1' ELSE '0' END AS is_error FROM events),
 b AS (SELECT user_id, count(*) AS k FROM (SELECT user_id, epoch_us(lead(ts, 2) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts) AS s FROM e) WHERE s < 86400000000 GROUP BY 1),
 a AS (SELECT user_id, count(*) FILTER (value > 200) AS big, count(*) FILTER (is_error = '1') / count(*) * 100 AS bad, count(*) AS n FROM e GROUP BY 1)
 SELECT user_id, 'large_transactions' AS indicator, 'medium' AS severity, big::DOUBLE AS amount FROM a WHERE big > 0 UNION ALL SELECT user_id, 'high_failure_rate', 'medium', {R('bad')} FROM a WHERE bad > 20
 UNION ALL SELECT user_id, 'burst_activity', 'low', k::DOUBLE FROM a JOIN b USING (user_id) WHERE n > 3""")
def _(spark, d):
    e = table(spark, d, "events").withColumn("is_error", F.when((F.col("event_type") == "error") | (F.col("event_id") % 4 == 0), "1").otherwise("0"))
    return rounded(C.tx_risk_indicators(e, "user_id", large=200.0, burst=3, seconds=86400), "amount")


@query("c_06_token_ledger", f"""WITH {PROFILE}, l AS (SELECT address, token, count(*) FILTER (incoming) AS transfers_in, count(*) FILTER (NOT incoming) AS transfers_out, sum(CASE WHEN incoming THEN value ELSE 0 END) AS vi, sum(CASE WHEN NOT incoming THEN value ELSE 0 END) AS vo,
 min(ts) AS first_seen, max(ts) AS last_seen, epoch(max(ts) - min(ts)) / 86400 AS h FROM rows GROUP BY 1, 2)
 SELECT address, token, transfers_in, transfers_out, {R('vi', 2)} AS volume_in, {R('vo', 2)} AS volume_out, first_seen, last_seen, {R('h')} AS holding_days, CAST(row_number() OVER (PARTITION BY address ORDER BY transfers_in + transfers_out DESC, token) AS INTEGER) AS rank FROM l QUALIFY rank <= 2""")
def _(spark, d):
    df = C.token_ledger(txs(spark, d).select("sender", "recipient", "token", "value", "ts"), 2)
    return rounded(rounded(df, "volume_in", "volume_out", digits=2), "holding_days")


@query("c_07_token_category", "SELECT p_brand, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'stablecoins' WHEN p_brand IN ('Brand#21', 'Brand#3') THEN 'defi' ELSE 'other' END AS token_category, count(*) AS n FROM part GROUP BY 1, 2")
def _(spark, d):
    df = C.token_category(table(spark, d, "part"), "p_brand", {"stablecoins": ["Brand#11", "Brand#12"], "defi": ["Brand#21", "Brand#3"]})
    return df.groupBy("p_brand", "token_category").agg(F.count(F.lit(1)).alias("n"))


@query("c_08_fund_rollup", f"""WITH {WALLETS}, f AS (SELECT fund, string_agg(DISTINCT x, '|' ORDER BY x) AS factors FROM (SELECT fund, unnest(risk_factors) AS x FROM wallets) GROUP BY 1),
 h AS (SELECT fund, x, row_number() OVER (PARTITION BY fund ORDER BY count(*) DESC, x) AS k FROM (SELECT fund, unnest(security_features) AS x FROM wallets) GROUP BY 1, 2), t AS (SELECT fund, string_agg(x, '|' ORDER BY k) FILTER (k <= 2) AS top, count(*) AS token_count FROM h GROUP BY 1)
 SELECT fund, count(*) AS wallets, {R('sum(balance)', 2)} AS total_balance, CAST(sum(transaction_count) AS BIGINT) AS total_transactions, {R('avg(risk_score)')} AS average_risk, count(*) FILTER (risk_score >= 70) AS high_risk, count(*) FILTER (risk_score >= 30 AND risk_score < 70) AS medium_risk,
 count(*) FILTER (risk_score < 30) AS low_risk, {THREE.format('avg(risk_score)')} AS risk_level, any_value(factors) AS factors, any_value(top) AS top, any_value(token_count) AS token_count FROM wallets JOIN f USING (fund) JOIN t USING (fund) GROUP BY 1""")
def _(spark, d):
    df = C.fund_rollup(wallets(spark, d), tokens="security_features", k=2)
    df = df.withColumn("factors", F.array_join("risk_factors", "|")).withColumn("top", F.array_join("top_tokens", "|")).drop("risk_factors", "top_tokens")
    return rounded(df, "average_risk").withColumn("total_balance", r(F.col("total_balance"), 2))


ACTIVE = WALLETS + """, act AS (SELECT *, CASE WHEN active_days > 0 THEN transaction_count / active_days ELSE 0 END AS fr, floor(epoch(TIMESTAMP '2001-08-01' - last_activity) / 86400) AS silent FROM wallets),
 lev AS (SELECT *, CASE WHEN silent > 90 THEN 'Dormant' WHEN fr > 5 THEN 'High' WHEN fr > 1 THEN 'Medium' ELSE 'Low' END AS activity_level FROM act)"""


@query("c_09_activity_level", f"WITH {ACTIVE} SELECT wallet_id, {R('fr')} AS activity_frequency, activity_level FROM lev")
def _(spark, d):
    return C.activity_level(wallets(spark, d), F.lit("2001-08-01").cast("timestamp")).select("wallet_id", r("activity_frequency"), "activity_level")


@query("c_10_concentration", f"""WITH {HOLDINGS}, g AS (SELECT fund, count(*) AS n, sum(amount) AS s, sum(amount * amount) AS q, max(amount) AS m FROM holdings GROUP BY 1), k AS (SELECT *, q / (s * s) AS h, m / s * 100 AS l FROM g)
 SELECT fund, n, {R('h')} AS hhi, {R('l')} AS largest_pct, {R('CASE WHEN n > 1 THEN 100 * (1 - (h - 1.0 / n) / (1 - 1.0 / n)) ELSE 50 END', 4)} AS diversification_score, CASE WHEN l > 80 THEN 'High' WHEN l > 50 THEN 'Medium' ELSE 'Low' END AS concentration_risk FROM k""")
def _(spark, d):
    df = C.concentration(holdings(spark, d), "fund", "amount")
    return rounded(df, "hhi", "largest_pct").withColumn("diversification_score", r(F.col("diversification_score"), 4))


@query("c_11_pattern_assessment", f"""WITH {ACTIVE}, g AS (SELECT fund, avg((activity_level = 'Dormant')::INT) AS d, avg((activity_level = 'High')::INT) AS b, avg(fr) AS f, coalesce(avg(CASE WHEN transaction_count > 0 THEN contract_interactions / transaction_count * 100 END), 0) AS c FROM lev GROUP BY 1),
 s AS (SELECT *, least(100.0, 50 + 10 * ((d > 0.3)::INT + (b > 0.3)::INT + (c > 70)::INT))::DOUBLE AS sc FROM g)
 SELECT fund, {R('d')} AS dormant_share, {R('b')} AS busy_share, {R('f')} AS avg_frequency, {R('c')} AS avg_contract_pct, sc AS pattern_risk_score, {THREE.format('sc')} AS pattern_risk_level, CASE WHEN f > 3 THEN 'High' WHEN f < 0.5 THEN 'Low' ELSE 'Normal' END AS frequency_class FROM s""")
def _(spark, d):
    df = C.pattern_assessment(C.activity_level(wallets(spark, d), F.lit("2001-08-01").cast("timestamp")), "fund")
    return rounded(df, "dormant_share", "busy_share", "avg_frequency", "avg_contract_pct").drop("unusual_patterns")


@query("c_12_security_coverage", f"""WITH {WALLETS}, z AS (SELECT fund, count(*) AS wallets FROM wallets GROUP BY 1), c AS (SELECT fund, x, count(*) AS n FROM (SELECT fund, unnest(security_features) AS x FROM wallets) GROUP BY 1, 2),
 s AS (SELECT fund, any_value(wallets) AS wallets, sum(CASE x WHEN 'Multi-sig' THEN 40 WHEN 'Hardware Security' THEN 30 WHEN 'Time-locked' THEN 15 WHEN 'Daily limits' THEN 15 ELSE 0 END) - 10 * count(*) FILTER (n / wallets * 100 < 50) AS p FROM c JOIN z USING (fund) GROUP BY 1)
 SELECT fund, wallets, least(100.0, greatest(0.0, p))::DOUBLE AS security_score FROM s""")
def _(spark, d):
    return C.security_coverage(wallets(spark, d), "fund").drop("recommendations")


@query("c_12_feature_coverage", f"WITH {WALLETS}, z AS (SELECT fund, count(*) AS w FROM wallets GROUP BY 1), c AS (SELECT fund, x AS feature, count(*) AS n FROM (SELECT fund, unnest(security_features) AS x FROM wallets) GROUP BY 1, 2) SELECT fund, feature, n, {R('n / w * 100')} AS coverage_pct FROM c JOIN z USING (fund)")
def _(spark, d):
    return rounded(C.feature_coverage(wallets(spark, d), "fund"), "coverage_pct")


@query("c_13_attribute_risk", f"""WITH {WALLETS}, s AS (SELECT wallet_id, {CLAMP.format("50.0 + CASE WHEN active_days > 365 THEN -10 WHEN active_days < 30 THEN 15 ELSE 0 END + CASE WHEN transaction_count > 1000 THEN -5 WHEN transaction_count < 10 THEN 10 ELSE 0 END - least(20, len(security_features) * 5) + CASE wallet_type WHEN 'Cold Storage' THEN -15 WHEN 'Hot Wallet' THEN 5 ELSE 0 END + len(risk_factors) * 5")}::DOUBLE AS x FROM wallets)
 SELECT wallet_id, x AS attribute_score, {THREE.format('x')} AS attribute_level FROM s""")
def _(spark, d):
    return C.attribute_risk(wallets(spark, d).withColumn("age_days", F.col("active_days"))).select("wallet_id", "attribute_score", "attribute_level")


NAMED = HOLDINGS + """, named AS (SELECT fund, CASE CAST(substr(asset, 7) AS INTEGER) % 9 WHEN 0 THEN 'Bitcoin' WHEN 1 THEN 'Ether staked (Lido)' WHEN 2 THEN 'USDC cash' WHEN 3 THEN 'Aave lending v3' WHEN 4 THEN 'Solana' WHEN 5 THEN 'NFT locked' WHEN 6 THEN 'Wormhole bridge farm' WHEN 7 THEN 'Uniswap LP' ELSE 'ETH' END || ' ' || asset AS asset, allocation FROM holdings)"""


def named(spark, d):
    k = F.expr("CAST(substring(asset, 7) AS INT) % 9")
    names = ["Bitcoin", "Ether staked (Lido)", "USDC cash", "Aave lending v3", "Solana", "NFT locked", "Wormhole bridge farm", "Uniswap LP", "ETH"]
    label = F.element_at(F.array(*[F.lit(x) for x in names]), k + 1)
    return holdings(spark, d).select("fund", F.concat(label, F.lit(" "), "asset").alias("asset"), "allocation")


def words(column, terms):
    return "(" + " OR ".join(f"contains(lower({column}), '{t}')" for t in terms) + ")"


@query("c_14_exposure", f"""WITH {NAMED}, x AS (SELECT DISTINCT fund, CASE {' '.join(f"WHEN {words('asset', ws)} THEN '{n}'" for n, ws in L.EXPOSURE_NAMES)} END AS e FROM named) SELECT fund, string_agg(e, '|' ORDER BY e) AS exposure FROM x WHERE e IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return C.exposure(named(spark, d)).select("fund", F.array_join("exposure", "|").alias("exposure"))


# ------------------------------------------------------------------------------- asset scores
MF = MARKET + """, mv AS (SELECT symbol, day, price, price / lag(price) OVER w - 1 AS rt, volume_24h / lag(volume_24h) OVER w - 1 AS rv, price / first_value(price) OVER w AS cum, row_number() OVER w AS i FROM market WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 dd AS (SELECT symbol, min(cum / mx - 1) AS mdd FROM (SELECT symbol, cum, i, max(CASE WHEN i > 1 THEN cum END) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS mx FROM mv) WHERE i > 1 GROUP BY 1),
 mr AS (SELECT symbol, stddev_samp(rt) AS vol, avg(rv) AS vch, count(*) FILTER (rt > 0) / count(*) FILTER (rt < 0) AS ratio FROM mv GROUP BY 1),
 mf AS (SELECT m.symbol, avg(price) AS pm, stddev_samp(price) AS ps, (max(price) - min(price)) / avg(price) AS rp, avg(volume_24h) AS vm, stddev_samp(volume_24h) AS vs, stddev_samp(price_change_24h) AS cs, avg(price_change_24h) AS cm, arg_max(price, day) AS pl, count(*) AS n, any_value(vol) AS vol, any_value(vch) AS vch, any_value(ratio) AS ratio, any_value(mdd) AS mdd
        FROM market m JOIN mr USING (symbol) JOIN dd USING (symbol) GROUP BY 1)"""


@query("r_01_market_features", f"WITH {MF} SELECT symbol, pl AS price_last, {R('pm', 4)} AS price_mean, {R('ps', 4)} AS price_std, {R('rp')} AS price_range_pct, {R('vm', 3)} AS volume_mean, {R('cs')} AS price_change_std, {R('vol')} AS volatility, {R('vch')} AS volume_change, {R('ratio')} AS pos_neg_ratio, {R('mdd')} AS max_drawdown, n AS market_points FROM mf")
def _(spark, d):
    df = S.market_features(market(spark, d), "symbol", "day")
    return df.select("symbol", "price_last", r("price_mean", 4), r("price_std", 4), r("price_range_pct"), r("volume_mean", 3), r("price_change_std"), r("volatility"), r("volume_change"), r("pos_neg_ratio"), r("max_drawdown"), "market_points")


SF = NEWS + """, nh AS (SELECT symbol, score, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM news), nt AS (SELECT symbol, avg(score) FILTER (i >= n // 2) - avg(score) FILTER (i < n // 2) AS tr FROM nh GROUP BY 1),
 sf AS (SELECT symbol, avg(score) AS sm, stddev_samp(score) AS ss, arg_max(score, (ts, event_id)) AS sl, count(*) FILTER (label = 'POSITIVE') / count(*) AS rp, count(*) FILTER (label = 'NEGATIVE') / count(*) AS rn, count(*) FILTER (label = 'NEUTRAL') / count(*) AS ru,
        count(*) FILTER (label = 'POSITIVE') / count(*) FILTER (label = 'NEGATIVE') AS pn, count(*) AS n, any_value(tr) AS tr FROM news JOIN nt USING (symbol) GROUP BY 1)"""


@query("r_02_sentiment_features", f"WITH {SF} SELECT symbol, {R('sm')} AS sentiment_mean, {R('ss')} AS sentiment_std, {R('sl')} AS sentiment_last, {R('rp')} AS sentiment_positive_ratio, {R('rn')} AS sentiment_negative_ratio, {R('ru')} AS sentiment_neutral_ratio, {R('pn')} AS pos_neg_sentiment_ratio, n AS news_count, {R('tr')} AS sentiment_trend FROM sf")
def _(spark, d):
    df = S.sentiment_features(news(spark, d), "symbol", "ts", tie=[F.col("event_id")])
    return rounded(df, "sentiment_mean", "sentiment_std", "sentiment_last", "sentiment_positive_ratio", "sentiment_negative_ratio", "sentiment_neutral_ratio", "pos_neg_sentiment_ratio", "sentiment_trend")


NAMES = "CASE symbol WHEN 'click' THEN '1-URGENT' WHEN 'view' THEN '2-HIGH' WHEN 'purchase' THEN '3-MEDIUM' ELSE symbol END"


@query("r_03_asset_risk", f"""WITH {MF}, {SF}, sn AS (SELECT * EXCLUDE (symbol), {NAMES} AS symbol FROM sf), j AS (SELECT symbol, coalesce(rp_, 0) AS rp, coalesce(cs, 0) AS cs, coalesce(vol, 0) AS vol, coalesce(mdd, 0) AS mdd, coalesce(sm, 0) AS sm, coalesce(ss, 0) AS ss, coalesce(rn, 0) AS rn, coalesce(tr, 0) AS tr, CASE WHEN vm > 0 THEN vs / vm ELSE 0 END AS un
 FROM (SELECT symbol, rp AS rp_, cs, vol, mdd, vm, vs FROM mf) FULL JOIN (SELECT symbol, sm, ss, rn, tr FROM sn) USING (symbol)),
 t AS (SELECT *, {CLAMP.format('0.35 * (rp * 30 + cs * 10) + 0.35 * (vol * 50 + abs(mdd) * 20) + 0.2 * ((1 - sm) * 15 + ss * 10 + rn * 20 + greatest(0, -tr * 15)) + 0.1 * (un * 15)')} AS x FROM j)
 SELECT symbol, round(x, 2) AS risk_score, {FIVE.format('x', 'Moderate')} AS risk_category, array_to_string(list_filter([CASE WHEN x > 80 THEN 'Overall risk profile: Very High' WHEN x > 60 THEN 'Overall risk profile: High' END, CASE WHEN vol > 0.05 THEN 'High price volatility' END, CASE WHEN rn > 0.5 THEN 'High negative sentiment' END,
 CASE WHEN tr < -0.1 THEN 'Declining sentiment trend' END, CASE WHEN mdd < -0.15 THEN 'Significant price drawdown' END, CASE WHEN un > 0.5 THEN 'Unstable trading volume' END, CASE WHEN cs > 5 THEN 'Erratic price changes' END], lambda q: q IS NOT NULL), '|') AS factors FROM t""")
def _(spark, d):
    from tidemark.operators.joins import full_features
    name = F.when(F.col("symbol") == "click", "1-URGENT").when(F.col("symbol") == "view", "2-HIGH").when(F.col("symbol") == "purchase", "3-MEDIUM").otherwise(F.col("symbol"))
    mood = S.sentiment_features(news(spark, d), "symbol", "ts", tie=[F.col("event_id")]).withColumn("symbol", name)
    df = S.asset_risk(full_features(S.market_features(market(spark, d), "symbol", "day"), mood, ["symbol"]))
    return df.select("symbol", "risk_score", "risk_category", F.array_join("risk_factors", "|").alias("factors"))


@query("r_04_expanding_lookback", """WITH w(k, x) AS (VALUES (0, 3), (1, 7), (2, 14), (3, 30), (4, 60), (5, 400)), c AS (SELECT o_custkey, x, k, count(*) FILTER (o_orderdate >= TIMESTAMP '2001-08-01' - to_days(x) AND o_orderdate <= TIMESTAMP '2001-08-01') AS n FROM orders, w GROUP BY 1, 2, 3)
 SELECT o_custkey, CAST(arg_min(x, k) FILTER (n > 0) AS INTEGER) AS window_days, coalesce(arg_min(n, k) FILTER (n > 0), 0) AS n FROM c GROUP BY 1""")
def _(spark, d):
    return S.expanding_lookback(table(spark, d, "orders"), "o_custkey", "o_orderdate", [3, 7, 14, 30, 60, 400], F.lit("2001-08-01").cast("timestamp"))


# ------------------------------------------------------------------------------- fund components
FUND_OF = "CASE WHEN symbol IN ('1-URGENT', '2-HIGH') THEN 'alpha' ELSE 'beta' END"


@query("r_05_market_risk", f"""WITH {MARKET}, a AS (SELECT symbol, price, day, price / lag(price) OVER (PARTITION BY symbol ORDER BY day) - 1 AS rt, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS age FROM market),
 q AS (SELECT symbol, price / lag(price) OVER (PARTITION BY symbol ORDER BY day) - 1 AS x FROM a WHERE age <= 90), v AS (SELECT {FUND_OF} AS fund, avg(av) AS vol FROM (SELECT symbol, stddev_samp(x) * sqrt(252) * 100 AS av FROM q GROUP BY 1) GROUP BY 1),
 dn AS (SELECT {FUND_OF} AS fund, max(abs(dd)) AS dd FROM (SELECT symbol, (arg_max(price, day) / max(price) - 1) * 100 AS dd FROM market GROUP BY 1) GROUP BY 1),
 cr AS (SELECT CASE WHEN a.symbol IN ('1-URGENT', '2-HIGH') THEN 'alpha' ELSE 'beta' END AS fund, abs(corr(a.price, b.price)) AS c FROM market a JOIN market b ON a.day = b.day AND a.symbol < b.symbol GROUP BY a.symbol, b.symbol),
 g AS (SELECT fund, vol, dd, (SELECT avg(c) FROM cr WHERE cr.fund = v.fund) AS ac, (SELECT count(*) FILTER (c > 0.8) / count(*) * 100 FROM cr WHERE cr.fund = v.fund) AS hp FROM v JOIN dn USING (fund)),
 s AS (SELECT *, {TEN.format("greatest(least(10.0, greatest(0.0, vol / 15)), CASE WHEN dd > 50 THEN 8.5 ELSE 0 END, CASE WHEN ac > 0.6 OR hp > 50 THEN least(9.0, 7 + (ac - 0.6) * 5) ELSE 0 END)")} AS sc FROM g)
 SELECT fund, {R('vol', 4)} AS avg_volatility, {R('dd')} AS worst_drawdown, {R('ac')} AS avg_abs_correlation, {R('sc')} AS score, {FIVE.format('sc * 10', 'Medium')} AS level FROM s""")
def _(spark, d):
    from tidemark.plans.bindings import PRIORITIES
    m = market(spark, d)
    fund = F.when(F.col("symbol").isin("1-URGENT", "2-HIGH"), "alpha").otherwise("beta")
    vol = series.volatility(m, "symbol", "day", "price").select(fund.alias("fund"), "annual_volatility")
    down = series.high_low_drawdown(m, "symbol", "day", "price").select(fund.alias("fund"), "current_drawdown_pct")
    pairs = series.pair_correlation(m, "symbol", "day", "price", PRIORITIES).select(F.when(F.col("key_a").isin("1-URGENT", "2-HIGH"), "alpha").otherwise("beta").alias("fund"), "correlation")
    df = S.market_risk(vol, down, pairs)
    return df.select("fund", r("avg_volatility", 4), r("worst_drawdown"), r("avg_abs_correlation"), r("score"), "level")


DEFI = words("asset", L.DEFI_WORDS)
KIND = "CASE " + " ".join(f"WHEN {words('asset', ws)} THEN {v}" for _, ws, v in L.PROTOCOL_KINDS) + " ELSE 7.0 END"


@query("r_06_contract_risk", f"""WITH {NAMED}, p AS (SELECT fund, CASE WHEN {DEFI} THEN allocation ELSE 0 END AS a, {KIND} AS k FROM named), g AS (SELECT fund, sum(a) AS x, sum(a * k) AS w, sum(CASE WHEN k > 7 THEN a ELSE 0 END) AS h FROM p GROUP BY 1),
 s AS (SELECT *, {TEN.format('CASE WHEN x > 0 THEN 4 + x * 4 + (w / x - 5) * 0.5 ELSE 5 END + CASE WHEN h > 0.2 THEN 1.5 ELSE 0 END')} AS sc FROM g)
 SELECT fund, {R('x')} AS exposure, {R('h')} AS high_risk_exposure, {R('sc')} AS score, {FIVE.format('sc * 10', 'Medium')} AS level FROM s""")
def _(spark, d):
    return S.contract_risk(named(spark, d)).select("fund", r("exposure"), r("high_risk_exposure"), r("score"), "level")


@query("r_06_new_protocol_risk", f"""WITH {NAMED}, g AS (SELECT fund, sum(CASE WHEN {words('asset', ['defi', 'protocol', 'compound', 'aave', 'uniswap', 'curve', 'swap', 'yield', 'lending'])} THEN allocation ELSE 0 END) AS x, sum(CASE WHEN {words('asset', ['v3', 'beta', 'new', 'flux', 'sushi', 'pancake'])} THEN allocation ELSE 0 END) AS n FROM named GROUP BY 1),
 s AS (SELECT *, {TEN.format('3 + x * 10 + CASE WHEN n > 0.1 THEN 1.5 ELSE 0 END + CASE WHEN x > 0.1 THEN 1 ELSE 0 END')} AS sc FROM g) SELECT fund, {R('x')} AS defi_share, {R('n')} AS new_share, {R('sc')} AS score, {COMP.format('sc')} AS level FROM s""")
def _(spark, d):
    return rounded(S.new_protocol_risk(named(spark, d)), "defi_share", "new_share", "score")


def fund_terms(spark, d):
    k = F.col("s_suppkey")
    lock = F.when(k % 5 == 0, "24 months").when(k % 5 == 1, "daily").when(k % 5 == 2, "1 year").when(k % 5 == 3, "2 months, quarterly").otherwise("")
    return table(spark, d, "supplier").select(k.alias("fund"), lock.alias("lock_up"), (F.abs("s_acctbal") / 1000 + 1).alias("aum"))


TERMS = """terms AS (SELECT s_suppkey AS fund, CASE s_suppkey % 5 WHEN 0 THEN '24 months' WHEN 1 THEN 'daily' WHEN 2 THEN '1 year' WHEN 3 THEN '2 months, quarterly' ELSE '' END AS lock_up, abs(s_acctbal) / 1000 + 1 AS aum FROM supplier)"""
TIER = f"CASE WHEN {words('asset', L.ILLIQUID_WORDS)} THEN 'low' WHEN {words('asset', L.LIQUID_WORDS)} THEN 'high' WHEN {words('asset', L.MAJOR_WORDS)} THEN 'med' ELSE 'rest' END"


@query("r_07_liquidity_risk", f"""WITH {NAMED}, {TERMS}, g AS (SELECT fund, sum(CASE WHEN {TIER} = 'high' THEN allocation ELSE 0 END) AS h, sum(CASE WHEN {TIER} = 'med' THEN allocation ELSE 0 END) AS m, sum(CASE WHEN {TIER} = 'low' THEN allocation ELSE 0 END) AS l FROM named GROUP BY 1),
 t AS (SELECT g.*, CASE lock_up WHEN '24 months' THEN 24 WHEN '1 year' THEN 12 WHEN '2 months, quarterly' THEN 2 ELSE 0 END AS mo, CASE lock_up WHEN 'daily' THEN 'daily' WHEN '2 months, quarterly' THEN 'quarterly' ELSE 'unknown' END AS fq FROM g JOIN terms USING (fund)),
 im AS (SELECT n.fund, count(*) AS k FROM named n JOIN terms USING (fund) WHERE allocation >= 0.05 AND contains(lower(asset), 'never') GROUP BY 1),
 s AS (SELECT *, {TEN.format("m * 3 + (1 - h - m - l) * 6 + l * 10 + CASE WHEN h < 0.05 THEN 1 ELSE 0 END + CASE WHEN l > 0.3 THEN 2 ELSE 0 END + CASE WHEN mo > 12 OR fq = 'annually' THEN 1 WHEN mo = 0 AND fq = 'daily' THEN -1 WHEN fq = 'unknown' AND mo = 0 THEN 1 ELSE 0 END + CASE WHEN mo < 3 AND l > 0.2 THEN 2 ELSE 0 END")} AS sc FROM t)
 SELECT fund, {R('h')} AS high_share, {R('m')} AS med_share, {R('l')} AS low_share, mo::INTEGER AS lock_up_months, fq AS redemption, {R('sc')} AS score, {FIVE.format('sc * 10', 'Medium')} AS level FROM s""")
def _(spark, d):
    df = S.liquidity_risk(named(spark, d), fund_terms(spark, d))
    return df.select("fund", r("high_share"), r("med_share"), r("low_share"), "lock_up_months", "redemption", r("score"), "level")


@query("r_07_market_impact", f"""WITH {HOLDINGS}, {TERMS}, v AS (SELECT p_brand, sum(p_retailprice) AS vol FROM part GROUP BY 1), g AS (SELECT fund, count(*) FILTER (vol > 0 AND aum * 1000000 * allocation / vol > 0.05) AS k FROM holdings JOIN terms USING (fund) JOIN v ON v.p_brand = asset WHERE allocation >= 0.05 GROUP BY 1)
 SELECT f.fund, coalesce(k, 0) AS impact_assets FROM (SELECT DISTINCT fund FROM holdings) f LEFT JOIN g USING (fund)""")
def _(spark, d):
    vol = table(spark, d, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.sum("p_retailprice").alias("volume_24h"))
    # Brand names contain each other ("Brand#1" in "Brand#11"); equal names win over contained ones.
    df = S.liquidity_risk(holdings(spark, d), fund_terms(spark, d), vol)
    return df.select("fund", F.coalesce("impact_assets", F.lit(0)).alias("impact_assets"))


@query("r_07_liquidity_model_two", f"""WITH {NAMED}, {TERMS}, g AS (SELECT fund, sum(CASE WHEN {words('asset', ['cash', 'usd', 'usdt', 'usdc', 'dai', 'stablecoin'])} THEN allocation ELSE 0 END) AS h, sum(CASE WHEN {words('asset', ['bitcoin', 'btc', 'ethereum', 'eth', 'bnb', 'sol'])} THEN allocation ELSE 0 END) AS m,
 sum(CASE WHEN {words('asset', ['nft', 'locked', 'staking', 'illiquid', 'altcoin'])} THEN allocation ELSE 0 END) AS l FROM named GROUP BY 1), t AS (SELECT *, 1 - (h + m + l) AS rest, CASE lock_up WHEN '24 months' THEN 24 WHEN '1 year' THEN 12 WHEN '2 months, quarterly' THEN 2 ELSE 0 END AS mo FROM g JOIN terms USING (fund)),
 s AS (SELECT fund, {TEN.format("(5 + CASE WHEN h < 0.1 THEN 1.5 ELSE 0 END + CASE WHEN l > 0.3 THEN 2 ELSE 0 END) * 0.5 + (m * 0.3 + rest * 0.6 + l) * 5 + CASE WHEN lock_up = '' THEN 1 WHEN mo < 1 AND l + rest > 0.4 THEN 2.5 WHEN mo < 3 AND l > 0.2 THEN 1.5 ELSE 0 END")} AS sc FROM t)
 SELECT fund, {R('sc')} AS score, {COMP.format('sc')} AS level FROM s""")
def _(spark, d):
    return rounded(S.liquidity_model_two(named(spark, d), fund_terms(spark, d)), "score")


def teams(spark, d):
    k = F.col("c_custkey")
    base = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("fund")).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    titles = F.array_compact(F.array(F.when(n % 2 == 0, "CIO and investment lead"), F.when(n % 3 == 0, "Risk officer"), F.when(n % 5 == 0, "CTO")))
    guard = F.array_compact(F.array(F.when(n % 4 != 0, "Quarterly audit"), F.when(n % 7 == 0, "Round the clock monitoring")))
    return base.select("fund", "n", titles.alias("titles"), guard.alias("security_team"))


TEAM = """team AS (SELECT c_mktsegment AS fund, count(*) AS n FROM customer GROUP BY 1)"""


@query("r_08_operational_risk", f"""WITH {WALLETS}, {TEAM}, w AS (SELECT fund, count(*) AS c, count(*) FILTER (len(list_filter(security_features, lambda x: contains(lower(x), 'multi-sig'))) > 0) AS ms, count(*) FILTER (list_contains(security_features, 'Hardware Security')) AS hw FROM wallets GROUP BY 1),
 s AS (SELECT fund, {TEN.format("5.0 + CASE WHEN n % 2 <> 0 AND n % 3 <> 0 AND n % 5 <> 0 THEN 2 ELSE CASE WHEN n % 2 <> 0 THEN 1.5 ELSE 0 END + CASE WHEN n % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN n % 5 <> 0 THEN 1 ELSE 0 END END + CASE WHEN n % 4 = 0 AND n % 7 <> 0 THEN 1.5 ELSE CASE WHEN n % 4 = 0 THEN 0.5 ELSE 0 END + CASE WHEN n % 7 <> 0 THEN 0.5 ELSE 0 END END + CASE WHEN ms / c < 0.5 THEN 1.5 ELSE 0 END + CASE WHEN hw / c < 0.3 THEN 1 ELSE 0 END")} AS sc FROM team JOIN w USING (fund))
 SELECT fund, {R('sc')} AS score, {FIVE.format('sc * 10', 'Medium')} AS level FROM s""")
def _(spark, d):
    return S.operational_risk(teams(spark, d), wallets(spark, d)).select("fund", r("score"), "level")


@query("r_08_team_risk", f"""WITH {TEAM}, s AS (SELECT fund, {TEN.format("5.0 + CASE WHEN n % 2 <> 0 AND n % 3 <> 0 AND n % 5 <> 0 THEN 2 ELSE CASE WHEN n % 5 <> 0 THEN 1.5 ELSE 0 END + CASE WHEN n % 2 <> 0 THEN 1.5 ELSE 0 END + 1 END + CASE WHEN n % 4 = 0 AND n % 7 <> 0 THEN 1.5 ELSE CASE WHEN n % 7 <> 0 THEN 1 ELSE 0 END + CASE WHEN n % 4 = 0 THEN 0.8 ELSE 0 END + 0.8 END")} AS sc FROM team)
 SELECT fund, {R('sc')} AS score, {COMP.format('sc')} AS level FROM s""")
def _(spark, d):
    return S.team_risk(teams(spark, d)).select("fund", r("score"), "level")


@query("r_09_concentration_risk", f"""WITH {HOLDINGS}, g AS (SELECT fund, sum(allocation * allocation) AS hhi, max(allocation) AS mx FROM holdings GROUP BY 1), c AS (SELECT fund, CASE WHEN mx * 100 > 80 THEN 'High' WHEN mx * 100 > 50 THEN 'Medium' ELSE 'Low' END AS cr, hhi, mx FROM g),
 o AS (SELECT *, CASE WHEN mx > 0.5 THEN greatest(least(10.0, hhi * 10), 7 + (mx - 0.5) * 5) ELSE least(10.0, hhi * 10) END AS one FROM c), s AS (SELECT *, {TEN.format("one * 0.8 + CASE cr WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END")} AS sc FROM o)
 SELECT fund, {R('hhi')} AS hhi, {R('mx')} AS largest, {R('sc')} AS score, {FIVE.format('sc * 10', 'Medium')} AS level FROM s""")
def _(spark, d):
    h = holdings(spark, d)
    return S.concentration_risk(h, C.concentration(h, "fund", "allocation")).select("fund", r("hhi"), r("largest"), r("score"), "level")


@query("r_09_portfolio_risk", f"""WITH {NAMED}, g AS (SELECT fund, sum(allocation * allocation) AS hhi, max(allocation) AS mx, sum(CASE WHEN {words('asset', ['usd', 'dai', 'stable'])} THEN allocation ELSE 0 END) AS st FROM named GROUP BY 1),
 s AS (SELECT *, {TEN.format('least(10.0, hhi * 10) + CASE WHEN st < 0.03 THEN 1 WHEN st >= 0.1 THEN -0.5 ELSE 0 END + CASE WHEN mx > 0.7 THEN 1.5 WHEN mx > 0.5 THEN 1 ELSE 0 END')} AS sc FROM g) SELECT fund, {R('hhi')} AS hhi, {R('mx')} AS largest, {R('st')} AS stable_share, {R('sc')} AS score, {COMP.format('sc')} AS level FROM s""")
def _(spark, d):
    return rounded(S.portfolio_risk(named(spark, d)), "hhi", "largest", "stable_share", "score")


@query("r_10_wallet_security_risk", f"""WITH {WALLETS}, p AS (SELECT fund, balance, wallet_type, 10 - {TEN.format("CASE WHEN wallet_id % 2 = 0 THEN 4 WHEN wallet_id % 7 = 1 THEN 3 ELSE 0 END + CASE WHEN wallet_id % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN wallet_id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN wallet_id % 11 = 0 THEN 1 ELSE 0 END + CASE wallet_type WHEN 'Cold Storage' THEN 2 WHEN 'Hot Wallet' THEN -2 ELSE 0 END")} AS x,
 (wallet_id % 2 = 0 OR wallet_id % 7 = 1)::INT AS ms, (wallet_id % 3 = 0)::INT AS hw FROM wallets), g AS (SELECT fund, avg(x) AS sc, avg(ms) AS ms, avg(hw) AS hw, CASE WHEN sum(balance) > 0 THEN sum(CASE WHEN wallet_type = 'Hot Wallet' THEN balance ELSE 0 END) / sum(balance) ELSE 0 END AS hot FROM p GROUP BY 1)
 SELECT fund, {R('sc')} AS score, {R('ms')} AS multisig_share, {R('hw')} AS hardware_share, {R('hot')} AS hot_share, {COMP.format('sc')} AS level FROM g""")
def _(spark, d):
    return rounded(S.wallet_security_risk(wallets(spark, d)).drop("factors"), "score", "multisig_share", "hardware_share", "hot_share")


@query("r_10_volatility_class_risk", f"""WITH {NAMED}, p AS (SELECT fund, allocation, CASE {' '.join(f"WHEN contains(lower(asset), '{n.lower()}') THEN {v}" for n, v in L.VOLATILITY_CLASS.items())} ELSE 0.8 END AS v FROM named), g AS (SELECT fund, sum(v * allocation) / sum(allocation) * 10 AS sc FROM p GROUP BY 1)
 SELECT fund, {R('sc')} AS score, {COMP.format('sc')} AS level FROM g""")
def _(spark, d):
    return rounded(S.volatility_class_risk(named(spark, d)), "score")


# ------------------------------------------------------------------------------------ compliance
def lines(spark, d):
    """Status, KYC and tax statements per fund, written from the supplier table."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    s = table(spark, d, "supplier")
    status = F.when(k % 4 == 0, "Registered with the SEC").when(k % 4 == 1, "FCA application pending, approved in principle").when(k % 4 == 2, "Supervised by MAS").otherwise("No statement")
    kyc = F.when(n % 3 == 0, "KYC verification and SAR filing").when(n % 3 == 1, "Risk-based approach").otherwise("none")
    tax = F.when(n % 2 == 0, "Annual returns and 1099 forms").otherwise("none")
    return [s.select(k.alias("fund"), c.alias("line")) for c in (status, kyc, tax)]


def lst(items):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


LINES = """st AS (SELECT s_suppkey AS fund, CASE s_suppkey % 4 WHEN 0 THEN 'Registered with the SEC' WHEN 1 THEN 'FCA application pending, approved in principle' WHEN 2 THEN 'Supervised by MAS' ELSE 'No statement' END AS line FROM supplier),
 ky AS (SELECT s_suppkey AS fund, CASE s_nationkey % 3 WHEN 0 THEN 'KYC verification and SAR filing' WHEN 1 THEN 'Risk-based approach' ELSE 'none' END AS line FROM supplier), tx AS (SELECT s_suppkey AS fund, CASE s_nationkey % 2 WHEN 0 THEN 'Annual returns and 1099 forms' ELSE 'none' END AS line FROM supplier),
 bodies(j, b) AS (VALUES """ + ", ".join(f"('{j}', '{b.lower()}')" for j, bs in L.REGULATORY_BODIES.items() for b in [j, *bs]) + """), regs(j, b) AS (VALUES """ + ", ".join(f"('{j}', '{b.lower()}')" for j, bs in L.REGULATORY_BODIES.items() for b in bs) + """),
 kr(j, q, w) AS (VALUES """ + ", ".join(f"('{j}', '{q}', {lst(q.lower().split())})" for j, qs in L.KYC_REQUIREMENTS.items() for q in qs) + """), tr(j, q, w) AS (VALUES """ + ", ".join(f"('{j}', '{q}', {lst(q.lower().split())})" for j, qs in L.TAX_REQUIREMENTS.items() for q in qs) + """),
 f0 AS (SELECT DISTINCT fund, j FROM st, bodies WHERE contains(lower(line), b)), pl AS (SELECT fund, j FROM f0 UNION ALL SELECT fund, unnest(['US', 'EU', 'Cayman Islands']) FROM (SELECT DISTINCT fund FROM st WHERE fund NOT IN (SELECT fund FROM f0))),
 hit AS (SELECT fund, j, count(DISTINCT b) AS n, max((contains(lower(line), 'registered') OR contains(lower(line), 'authorized') OR contains(lower(line), 'licensed') OR contains(lower(line), 'approved')) AND NOT contains(lower(line), 'pending')) AS reg,
   max((contains(lower(line), 'registered') OR contains(lower(line), 'authorized') OR contains(lower(line), 'licensed') OR contains(lower(line), 'approved')) AND contains(lower(line), 'pending')) AS pend FROM st, regs WHERE contains(lower(line), b) GROUP BY 1, 2),
 rg AS (SELECT pl.fund, pl.j, CASE WHEN reg THEN 'Registered' WHEN pend THEN 'Pending' WHEN n > 0 THEN 'Mentioned' ELSE 'No Registration Found' END AS registration, coalesce(n, 0) AS n FROM pl LEFT JOIN hit USING (fund, j)),
 rs AS (SELECT *, CASE registration WHEN 'Registered' THEN least(100.0, 85 + 5 * (n - 1)) WHEN 'Pending' THEN 60 WHEN 'Mentioned' THEN 40 ELSE 20 END AS sc FROM rg),
 kc AS (SELECT pl.fund, pl.j, count(DISTINCT q) FILTER (len(list_filter(w, lambda x: contains(lower(line), x))) > 0) / count(DISTINCT q) * 100 AS c FROM pl JOIN kr USING (j) JOIN ky USING (fund) GROUP BY 1, 2),
 tc AS (SELECT pl.fund, pl.j, count(DISTINCT q) FILTER (len(list_filter(w, lambda x: contains(lower(line), x))) > 0) / count(DISTINCT q) * 100 AS c FROM pl JOIN tr USING (j) JOIN tx USING (fund) GROUP BY 1, 2),
 cs AS (SELECT fund, avg(sc) AS r, count(*) FILTER (registration <> 'Registered') AS g, max(registration = 'No Registration Found' AND j IN ('US', 'EU', 'UK', 'Singapore')) AS um, count(*) AS jn FROM rs GROUP BY 1),
 co AS (SELECT cs.*, coalesce((SELECT avg(c) FROM kc WHERE kc.fund = cs.fund), 0) AS k, coalesce((SELECT avg(c) FROM tc WHERE tc.fund = cs.fund), 0) AS t, (SELECT count(*) FROM kc WHERE kc.fund = cs.fund AND c < 50) + (SELECT count(*) FROM tc WHERE tc.fund = cs.fund AND c < 50) + g AS gaps FROM cs)"""


@query("r_11_regulatory_risk", f"""WITH {LINES}, a AS (SELECT fund, 0.5 * r + 0.3 * k + 0.2 * t AS o, gaps, k, um FROM co), b AS (SELECT *, least(10.0, (100 - o) / 10 + gaps * 0.5) AS x FROM a), c AS (SELECT *, CASE WHEN k < 50 THEN least(10.0, x + 1) ELSE x END AS y FROM b), z AS (SELECT fund, {TEN.format('CASE WHEN um THEN least(10.0, y + 1.5) ELSE y END')} AS sc FROM c)
 SELECT fund, {R('sc')} AS score, {FIVE.format('sc * 10', 'Medium')} AS level FROM z""")
def _(spark, d):
    return S.regulatory_risk(S.compliance_score(*lines(spark, d))).select("fund", r("score"), "level")


@query("r_11_compliance_documentation_risk", f"""WITH {LINES}, z AS (SELECT st.fund, {TEN.format("5.0 + 0.0 + CASE WHEN contains(lower(st.line), 'sec') THEN -1 ELSE 1.5 END + 0.5")} AS sc FROM st) SELECT fund, {R('sc')} AS score, {COMP.format('sc')} AS level FROM z""")
def _(spark, d):
    status, kyc, tax = lines(spark, d)
    funds = (status.select("fund", F.array("line").alias("regulatory_status")).join(kyc.select("fund", F.array("line").alias("kyc_aml")), "fund")
             .join(tax.select("fund", F.array("line").alias("tax_considerations")), "fund"))
    return S.compliance_documentation_risk(funds).select("fund", r("score"), "level")


@query("r_12_overall_risk", f"""WITH {HOLDINGS}, {LINES}, h AS (SELECT fund, least(10.0, sum(allocation * allocation) * 10) AS c FROM holdings GROUP BY 1), q AS (SELECT fund, least(10.0, (100 - (0.5 * r + 0.3 * k + 0.2 * t)) / 10) AS g FROM co),
 s AS (SELECT fund, {CLAMP.format('10 * (5 * 0.25 + 5 * 0.20 + coalesce(g, 5) * 0.15 + 5 * 0.15 + 5 * 0.15 + coalesce(c, 5) * 0.10)')} AS x FROM h FULL JOIN q USING (fund)) SELECT fund, {R('x')} AS overall_risk_score, {FIVE.format('x', 'Medium')} AS risk_level FROM s""")
def _(spark, d):
    h = holdings(spark, d).groupBy("fund").agg(F.least(F.lit(10.0), F.sum(F.col("allocation") * F.col("allocation")) * 10).alias("score")).withColumn("component", F.lit("concentration_risk"))
    q = S.compliance_score(*lines(spark, d)).select("fund", F.least(F.lit(10.0), (100 - F.col("overall_score")) / 10).alias("score"), F.lit("regulatory_risk").alias("component"))
    return rounded(S.overall_risk(h.unionByName(q.select(*h.columns))), "overall_risk_score")


@query("r_12_factors_and_mitigations", f"""WITH {NAMED}, {TERMS}, g AS (SELECT fund, sum(CASE WHEN {TIER} = 'high' THEN allocation ELSE 0 END) AS h, sum(CASE WHEN {TIER} = 'low' THEN allocation ELSE 0 END) AS l FROM named GROUP BY 1), t AS (SELECT *, CASE lock_up WHEN '24 months' THEN 24 WHEN '1 year' THEN 12 WHEN '2 months, quarterly' THEN 2 ELSE 0 END AS mo FROM g JOIN terms USING (fund)),
 f AS (SELECT fund, 'Raise cash or stablecoin reserves' AS action FROM t WHERE h < 0.05 UNION ALL SELECT fund, 'Align redemption terms with portfolio liquidity' FROM t WHERE l > 0.3 OR (mo < 3 AND l > 0.2)) SELECT DISTINCT fund, action FROM f""")
def _(spark, d):
    return S.mitigations(S.ranked_factors(S.liquidity_risk(named(spark, d), fund_terms(spark, d))))


@query("r_13_compliance_score", f"""WITH {LINES}, z AS (SELECT *, 0.5 * r + 0.3 * k + 0.2 * t AS o FROM co) SELECT fund, {R('r')} AS registration_score, {R('k')} AS kyc_coverage, {R('t')} AS tax_coverage, {R('o')} AS overall_score, CASE WHEN o >= 85 THEN 'High' WHEN o >= 70 THEN 'Substantial' WHEN o >= 50 THEN 'Moderate' WHEN o >= 30 THEN 'Partial' ELSE 'Low' END AS compliance_level,
 gaps::BIGINT AS n_gaps, um AS unregistered_major, jn AS jurisdictions FROM z""")
def _(spark, d):
    return rounded(S.compliance_score(*lines(spark, d)), "registration_score", "kyc_coverage", "tax_coverage", "overall_score")


@query("r_13_compliance_gaps", f"""WITH {LINES} SELECT fund, j AS jurisdiction, CASE WHEN registration = 'No Registration Found' THEN 'no registration' ELSE 'incomplete registration' END AS gap, CASE WHEN registration = 'No Registration Found' THEN 'Initiate registration' ELSE 'Complete registration' END AS action FROM rg WHERE registration <> 'Registered'
 UNION ALL SELECT fund, j, 'missing KYC/AML procedures', 'Implement KYC/AML procedures' FROM kc WHERE c < 50 UNION ALL SELECT fund, j, 'missing tax measures', 'Consult tax advisors' FROM tc WHERE c < 50""")
def _(spark, d):
    return S.compliance_gaps(*lines(spark, d))


def _place(t):
    return "CASE WHEN contains(lower(source), 'src1') OR contains(lower(text), 'src1') THEN 'src1' WHEN contains(lower(source), 'les') OR contains(lower(text), 'les') THEN 'les' ELSE 'Global' END"


@query("r_14_regulatory_digest", f"""SELECT doc_id, source, {_place(0)} AS jurisdiction, contains(lower(text), 'new') OR contains(lower(text), 'update') OR contains(lower(text), 'recent') AS recent FROM documents WHERE lang = 'en' OR contains(source, 'regulatory')""")
def _(spark, d):
    df = table(spark, d, "documents").withColumn("kind", F.when(F.col("lang") == "en", "regulation").otherwise("other"))
    return S.regulatory_digest(df, doc="doc_id", kind="kind", title="source", text="text", places=["src1", "les"]).select("doc_id", "source", "jurisdiction", "recent")


# ----------------------------------------------------------------------------------- market views
@query("r_15_alerts", f"""WITH {WALLETS}, p AS (SELECT address AS symbol, floor(risk_score) AS s, {FIVE.format('floor(risk_score)', 'Moderate')} AS c, risk_factors FROM wallets)
 SELECT symbol, 'info' AS severity, symbol || ' score: ' || CAST(s::INT AS VARCHAR) || '.00 (' || c || ')' AS message FROM p UNION ALL SELECT symbol, 'high', 'High risk detected for ' || symbol || ': ' || CAST(s::INT AS VARCHAR) || '.0' FROM p WHERE s >= 80
 UNION ALL SELECT symbol, 'warning', 'Sentiment-related risk for ' || symbol FROM p WHERE list_contains(risk_factors, 'New counterparty')""")
def _(spark, d):
    from tidemark.functions.ladders import five_level
    p = wallets(spark, d).select(F.col("address").alias("symbol"), F.floor("risk_score").cast("double").alias("risk_score"), F.transform("risk_factors", lambda x: F.replace(x, F.lit("New counterparty"), F.lit("Weak sentiment"))).alias("risk_factors"))
    return S.alerts(p.withColumn("risk_category", five_level("risk_score")))


@query("r_16_risk_history", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderpriority = '5-LOW' ORDER BY o_orderdate")
def _(spark, d):
    return S.risk_history(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority"), "5-LOW", key="o_orderpriority", ts="o_orderdate").drop("o_orderpriority")


def _breadth(src):
    return f"SELECT {{0}} AS scope, count(price_change_24h) AS n, {R('count(*) FILTER (price_change_24h > 0) / count(price_change_24h)')} AS share_up, CASE WHEN count(*) FILTER (price_change_24h > 0) / count(*) > 0.7 THEN 'strongly bullish' WHEN count(*) FILTER (price_change_24h > 0) / count(*) > 0.6 THEN 'bullish' WHEN count(*) FILTER (price_change_24h > 0) / count(*) > 0.4 THEN 'neutral' WHEN count(*) FILTER (price_change_24h > 0) / count(*) > 0.3 THEN 'bearish' ELSE 'strongly bearish' END AS mood FROM {src}"


@query("r_17_breadth", f"WITH {MARKET}, l AS (SELECT * FROM market QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY day DESC) = 1) " + _breadth("market").format("'all'") + " UNION ALL " + _breadth("l").format("'latest'"))
def _(spark, d):
    m = market(spark, d)
    a = S.breadth(m).select(F.lit("all").alias("scope"), "*")
    return rounded(a.unionByName(S.breadth(m, scope="latest", ts="day").select(F.lit("latest").alias("scope"), "*")), "share_up")


@query("r_18_liquidity_ratio", f"WITH {MARKET} SELECT symbol, day, {R('volume_24h / market_cap')} AS liquidity_ratio FROM market")
def _(spark, d):
    return S.liquidity_ratio(market(spark, d)).select("symbol", "day", r("liquidity_ratio"))


@query("r_19_risk_vs_volatility", f"""WITH {MARKET}, {WALLETS}, a AS (SELECT (SELECT avg(risk_score) FROM wallets) AS x, (SELECT avg(abs(price_change_24h)) FROM market) AS v) SELECT {R('x')} AS avg_risk, {R('v')} AS avg_volatility, CASE WHEN v > 5 THEN 'highly volatile' WHEN v > 2 THEN 'moderately volatile' ELSE 'relatively stable' END AS market_condition,
 CASE WHEN x > 70 AND v > 3 THEN 'aligned high' WHEN x > 70 THEN 'hidden risk' WHEN x <= 30 AND v > 3 THEN 'long-term confidence' WHEN x <= 30 THEN 'stable' ELSE 'balanced' END AS verdict FROM a""")
def _(spark, d):
    return rounded(S.risk_vs_volatility(wallets(spark, d), market(spark, d)), "avg_risk", "avg_volatility")
