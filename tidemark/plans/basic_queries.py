"""Queries for predicates (P), joins (J), aggregates (A), ranking (K) and set operations (D)."""

from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import filters as P
from tidemark.operators import joins as J
from tidemark.operators import ranking as K
from tidemark.operators import series as S
from tidemark.operators import setops as D
from tidemark.plans.bindings import HOLDINGS, MARKET, NEWS, OHLC, PRIORITIES, WALLETS, holdings, market, news, ohlc, table, wallets
from tidemark.plans.registry import R, query, r, rounded

# ------------------------------------------------------------------ predicates and projections
LABELLED = """labelled AS (
  SELECT doc_id, source, lang, substr(text, 1, 40) AS title, text AS content, n_chars,
         list_filter([CASE WHEN contains(lower(text), 'the') THEN 'the' END, CASE WHEN contains(lower(text), 'and') THEN 'and' END,
                      CASE WHEN contains(lower(text), 'les') THEN 'les' END], lambda x: x IS NOT NULL) AS tags,
         CASE WHEN n_chars > 3000 THEN 'completed' WHEN n_chars > 1000 THEN 'processing' ELSE 'pending' END AS processing_status
  FROM documents)"""


def labelled(spark, d):
    low = F.lower("text")
    return table(spark, d, "documents").select(
        "doc_id", "source", "lang", F.substring("text", 1, 40).alias("title"), F.col("text").alias("content"), "n_chars",
        F.array_compact(F.array(*[F.when(low.contains(w), w) for w in ("the", "and", "les")])).alias("tags"),
        F.when(F.col("n_chars") > 3000, "completed").when(F.col("n_chars") > 1000, "processing").otherwise("pending").alias("processing_status"))


@query("p_01_lookup", "SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def _(spark, d):
    df = P.lookup(table(spark, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, order=[F.col("o_orderdate").desc(), F.col("o_orderkey")], n=50)
    return df.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")


PAIRS = "CASE event_id % 4 WHEN 0 THEN upper(event_type) WHEN 1 THEN upper(event_type) || 'USDT' WHEN 2 THEN upper(event_type) || 'USD' ELSE event_type END"


def paired_events(spark, d):
    up = F.upper("event_type")
    return table(spark, d, "events").withColumn("symbol", F.when(F.col("event_id") % 4 == 0, up).when(F.col("event_id") % 4 == 1, F.concat(up, F.lit("USDT")))
                                                .when(F.col("event_id") % 4 == 2, F.concat(up, F.lit("USD"))).otherwise(F.col("event_type")))


@query("p_02_by_symbol", f"SELECT event_id, {PAIRS} AS symbol FROM events WHERE event_type IN ('click', 'purchase')")
def _(spark, d):
    return P.by_symbol(paired_events(spark, d), ["CLICK", "PURCHASEUSDT"]).select("event_id", "symbol")


@query("p_03_where_all", f"WITH {LABELLED} SELECT doc_id, source, lang FROM labelled WHERE n_chars >= 500 AND n_chars <= 4000 AND lang = 'en' AND list_contains(tags, 'and')")
def _(spark, d):
    return P.where_all(labelled(spark, d), ts="n_chars", since=500, until=4000, equals={"lang": "en"}, contains={"tags": "and"}).select("doc_id", "source", "lang")


@query("p_04_array_predicates", f"""WITH {LABELLED} SELECT doc_id, list_has_any(tags, ['and', 'les']) AS any_tag, list_has_all(tags, ['the', 'and']) AS all_tags,
 contains(lower(content), 'rewh') OR contains(lower(content), 'inoran') AS like_any FROM labelled""")
def _(spark, d):
    return labelled(spark, d).select("doc_id", P.contains_any("tags", ["and", "les"]).alias("any_tag"), P.contains_all("tags", ["the", "and"]).alias("all_tags"),
                                     P.like_any("content", ["rewh", "inoran"]).alias("like_any"))


@query("p_05_visible_to", "SELECT event_id, user_id FROM events WHERE user_id = 7 OR event_type = 'click'")
def _(spark, d):
    df = table(spark, d, "events").withColumn("is_public", F.col("event_type") == "click")
    return P.visible_to(df, 7).select("event_id", "user_id")


@query("p_06_facet_news", f"""WITH {LABELLED} SELECT doc_id FROM labelled WHERE (contains(lower(title), 'the') OR contains(lower(content), 'the')) AND lang = 'en' AND list_contains(tags, 'and') AND source = 'src3'""")
def _(spark, d):
    return P.facet_news(labelled(spark, d), text="the", label="en", asset="and", source="src3", label_col="lang", assets="tags").select("doc_id")


@query("p_07_facet_risk", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate <= DATE '1998-12-31'
 AND (contains(lower(o_orderpriority), 'high') OR contains(lower(o_orderstatus), 'high'))""")
def _(spark, d):
    df = P.facet_risk(table(spark, d, "orders"), start=F.lit("1997-01-01").cast("date"), end=F.lit("1998-12-31").cast("date"), text="HIGH", ts="o_orderdate",
                      score="o_totalprice", columns=["o_orderpriority", "o_orderstatus"])
    return df.select("o_orderkey", "o_totalprice")


@query("p_08_lookback", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAYS")
def _(spark, d):
    return P.lookback(table(spark, d, "events"), "ts", 10, "2024-01-31 00:00:00").select("event_id")


@query("p_09_preview", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents")
def _(spark, d):
    return P.preview(table(spark, d, "documents").select("doc_id", "text"), "text")


@query("p_10_resolve_columns", "SELECT o_orderkey AS id, o_orderdate AS timestamp, o_totalprice AS price, o_totalprice AS close, 0 AS volume FROM orders")
def _(spark, d):
    df = P.resolve_columns(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"),
                           {"id": ["orderkey"], "timestamp": ["time", "date"], "price": ["price", "close"], "volume": ["volume", "vol"]},
                           fill={"close": "price", "volume": 0})
    return df


@query("p_11_valid_rows", "SELECT event_id, user_id FROM events WHERE try_cast(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL AND event_type <> ''")
def _(spark, d):
    df = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return P.valid_rows(df, required=["event_type"], dates=["ts"], numeric=["k"]).select("event_id", "user_id")


@query("p_12_recent_feed", """SELECT event_id, ts, value, CASE WHEN s > 0.3 THEN 'positive' WHEN s < -0.3 THEN 'negative' ELSE 'neutral' END AS band
 FROM (SELECT *, (value - 50) / 50 AS s FROM events ORDER BY ts DESC, event_id LIMIT 40)""")
def _(spark, d):
    df = table(spark, d, "events").withColumn("s", (F.col("value") - 50) / 50)
    return P.recent_feed(df, "ts", 40, "s", tie=[F.col("event_id")]).select("event_id", "ts", "value", "band")


@query("p_13_facet_docs", f"""WITH {LABELLED} SELECT doc_id FROM labelled WHERE (contains(lower(title), 'on') OR len(list_filter(tags, lambda x: contains(x, 'on'))) > 0) AND processing_status = 'completed' AND lang = 'en'""")
def _(spark, d):
    return P.facet_docs(labelled(spark, d), text="on", status="completed", kind="en", arrays=["tags"], kind_col="lang").select("doc_id")


# ------------------------------------------------------------------------------------- joins
@query("j_01_join_daily", f"""WITH {NEWS}, s AS (SELECT CAST(ts AS DATE) AS day, avg(score) AS mood FROM news WHERE symbol = 'click' GROUP BY 1),
 p AS (SELECT CAST(ts AS DATE) AS day, max(value) AS price FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT day, {R('mood')} AS mood, price FROM s JOIN p USING (day)""")
def _(spark, d):
    mood = news(spark, d).where("symbol = 'click'").groupBy(F.to_date("ts").alias("at")).agg(F.avg("score").alias("mood"))
    price = table(spark, d, "events").where("event_type = 'purchase'").groupBy(F.to_date("ts").alias("when")).agg(F.max("value").alias("price"))
    return J.join_daily(mood, price, "at", "when").select("day", r("mood"), "price")


@query("j_02_join_with_neutral", f"""WITH {OHLC}, s AS (SELECT CAST(l_shipdate AS DATE) AS day, avg(l_discount) AS mood, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
 SELECT symbol, day, close, {R('coalesce(mood, 0.5)')} AS mood, coalesce(n, 0) AS n FROM ohlc LEFT JOIN s USING (day)""")
def _(spark, d):
    mood = table(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.avg("l_discount").alias("mood"), F.count(F.lit(1)).alias("n"))
    return J.join_with_neutral(ohlc(spark, d).select("symbol", "day", "close"), mood, ["day"], {"mood": 0.5, "n": 0}).withColumn("mood", r(F.col("mood")))


@query("j_03_asof_join", """SELECT l.event_id, l.ts, r.ts AS ts_right, r.price FROM (SELECT * FROM events WHERE event_type = 'click') l
 ASOF LEFT JOIN (SELECT ts, value AS price FROM events WHERE event_type = 'purchase') r ON l.ts >= r.ts""")
def _(spark, d):
    e = table(spark, d, "events")
    left = e.where("event_type = 'click'").select("event_id", "ts")
    right = e.where("event_type = 'purchase'").select("ts", F.col("value").alias("price"), "event_id")
    return J.asof_join(left, right, "ts", ["price"], order="event_id")


@query("j_03_asof_join_by_key", """SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_shipdate, r.l_shipdate AS l_shipdate_right, r.price
 FROM (SELECT * FROM lineitem WHERE l_returnflag = 'R') l ASOF LEFT JOIN
 (SELECT l_suppkey, l_shipdate, arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) AS price FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2) r
 ON l.l_suppkey = r.l_suppkey AND l.l_shipdate >= r.l_shipdate""")
def _(spark, d):
    e = table(spark, d, "lineitem")
    left = e.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    right = e.where("l_returnflag = 'A'").select("l_suppkey", "l_shipdate", F.col("l_extendedprice").alias("price"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return J.asof_join(left, right, "l_shipdate", ["price"], by="l_suppkey", order="seq")


@query("j_04_interval_agg_join", f"""WITH p AS (SELECT event_id, ts AS lo, ts + INTERVAL 2 HOURS AS hi FROM events WHERE event_type = 'purchase')
 SELECT p.event_id, lo, hi, {R('avg(e.value)')} AS mean_value, count(e.value) AS n FROM p LEFT JOIN events e ON e.event_type = 'click' AND e.ts >= lo AND e.ts <= hi GROUP BY 1, 2, 3""")
def _(spark, d):
    e = table(spark, d, "events")
    points = e.where("event_type = 'purchase'").select("event_id", F.col("ts").alias("lo"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("hi"))
    clicks = e.where("event_type = 'click'").select("ts", "value")
    df = J.interval_agg_join(points, clicks, lo="lo", hi="hi", ts="ts", aggs={"mean_value": F.avg("value"), "n": F.count("value")}, grain="hour")
    return df.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("mean_value", r(F.col("mean_value")))


@query("j_04_interval_stats", f"""WITH p AS (SELECT event_id, ts AS lo, ts + INTERVAL 2 HOURS AS hi FROM events WHERE event_type = 'purchase')
 SELECT p.event_id, lo, hi, count(e.value) AS n, {R('sum(e.value)', 4)} AS total, {R('avg(e.value)')} AS mean FROM p LEFT JOIN events e ON e.event_type = 'click' AND e.ts >= lo AND e.ts <= hi GROUP BY 1, 2, 3""")
def _(spark, d):
    e = table(spark, d, "events")
    points = e.where("event_type = 'purchase'").select("event_id", F.col("ts").alias("lo"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("hi"))
    df = J.interval_stats(points, e.where("event_type = 'click'").select("ts", "value"), lo="lo", hi="hi", ts="ts", value="value")
    return df.withColumns({"total": r(F.col("total"), 4), "mean": r(F.col("mean"))})


@query("j_05_pair_join", f"WITH {OHLC} SELECT a.day, a.symbol AS key_a, b.symbol AS key_b, a.close AS value_a, b.close AS value_b FROM ohlc a JOIN ohlc b ON a.day = b.day AND a.symbol < b.symbol")
def _(spark, d):
    return J.pair_join(ohlc(spark, d), "symbol", "day", "close", PRIORITIES)


@query("j_06_common_keys", f"WITH {OHLC}, c AS (SELECT day FROM ohlc GROUP BY day HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM ohlc)) SELECT symbol, day, close FROM ohlc SEMI JOIN c USING (day)")
def _(spark, d):
    return J.common_keys(ohlc(spark, d).select("symbol", "day", "close"), "symbol", "day")


@query("j_07_enrich_portfolio", f"""WITH {HOLDINGS}, m AS (SELECT p_brand, max(p_retailprice) AS price FROM part GROUP BY 1), s AS (SELECT p_brand, avg(p_size) / 50 AS mood FROM part WHERE p_size > 10 GROUP BY 1)
 SELECT fund, asset, {R('allocation')} AS allocation, price, {R('mood')} AS mood, {R('1000000 * allocation', 3)} AS position_value
 FROM holdings LEFT JOIN m ON asset = m.p_brand LEFT JOIN s ON asset = s.p_brand WHERE allocation >= 0.001""")
def _(spark, d):
    part = table(spark, d, "part")
    m = part.groupBy(F.col("p_brand").alias("symbol")).agg(F.max("p_retailprice").alias("price"))
    s = part.where("p_size > 10").groupBy(F.col("p_brand").alias("symbol")).agg((F.avg("p_size") / 50).alias("mood"))
    df = J.enrich_portfolio(holdings(spark, d).select("fund", "asset", "allocation"), m, s, aum=F.lit(1_000_000))
    return df.select("fund", "asset", r("allocation"), "price", r("mood"), r("position_value", 3))


@query("j_08_substring_join", """WITH a AS (SELECT n_nationkey, 'Brand#' || (n_nationkey % 9) AS name FROM nation), s AS (SELECT DISTINCT p_brand FROM part),
 h AS (SELECT n_nationkey, name, p_brand, CASE WHEN lower(regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g')) = lower(name) THEN 0 ELSE 1 END AS k FROM a JOIN s ON contains(lower(p_brand), lower(name)))
 SELECT a.n_nationkey, a.name, (SELECT arg_min(p_brand, (k, p_brand)) FROM h WHERE h.n_nationkey = a.n_nationkey) AS p_brand FROM a""")
def _(spark, d):
    a = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("Brand#"), F.col("n_nationkey") % 9).alias("name"))
    return J.substring_join(a, table(spark, d, "part"), "name", "p_brand")


LEX = {"articles": ["the", "this", "that"], "links": ["and", "with", "from"], "rude": ["idiot", "clown", "loser"]}
LEX_SQL = " UNION ALL ".join(f"SELECT '{c}' AS category, '{t}' AS term" for c, ts in LEX.items() for t in ts)


@query("j_09_lexicon_join", f"""WITH lex AS ({LEX_SQL}) SELECT doc_id, category, term, CAST((length(lower(text)) - length(replace(lower(text), term, ''))) / length(term) AS BIGINT) AS n
 FROM documents, lex WHERE contains(lower(text), term)""")
def _(spark, d):
    return J.lexicon_join(table(spark, d, "documents"), LEX, doc="doc_id", text="text")


@query("j_09_lexicon_join_words", f"""WITH lex AS ({LEX_SQL}), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS t FROM documents)
 SELECT doc_id, category, term, count(*) AS n FROM w JOIN lex ON t = term GROUP BY 1, 2, 3""")
def _(spark, d):
    return J.lexicon_join(table(spark, d, "documents"), LEX, doc="doc_id", text="text", match="word")


@query("j_09_term_equi_join", """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS t FROM documents), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM benchmark)
 SELECT doc_id, term, count(*) AS n FROM w JOIN b ON t = term GROUP BY 1, 2""")
def _(spark, d):
    from tidemark.functions.texts import words
    terms = table(spark, d, "benchmark").select(F.explode(words("text")).alias("term")).distinct()
    return J.term_equi_join(table(spark, d, "documents"), terms, doc="doc_id", text="text").select("doc_id", "term", "n")


NAMES = ["idiot", "clown", "loser", "thanedble", "rewh"]


def _mention_sql():
    parts = [f"SELECT doc_id, '{n}' AS entity, {len(n)} AS size, regexp_split_to_array(lower(text), '{n}') AS p FROM documents" for n in NAMES]
    return "m0 AS (" + " UNION ALL ".join(parts) + """), m AS (SELECT doc_id, entity, size, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * size AS INTEGER) AS s
      FROM (SELECT doc_id, entity, size, p, unnest(generate_series(1, len(p) - 1)) AS i FROM m0))"""


@query("j_10_proximity_join", f"""WITH {_mention_sql()} SELECT a.doc_id, a.entity AS src, b.entity AS dst, count(*) AS weight FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.entity <> b.entity
 AND ((b.s >= greatest(a.s - 150, 0) AND b.s <= a.s + a.size + 150) OR (b.s + b.size >= greatest(a.s - 150, 0) AND b.s + b.size <= a.s + a.size + 150)) GROUP BY 1, 2, 3""")
def _(spark, d):
    return J.proximity_join(J.mentions(table(spark, d, "documents"), NAMES, doc="doc_id", text="text"), doc="doc_id")


@query("j_11_missing_from", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, d):
    seen = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return J.missing_from(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), seen, ["c_custkey"])


@query("j_12_having_recent", """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 365 DAYS GROUP BY 1 HAVING count(*) >= 3)""")
def _(spark, d):
    return J.having_recent(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", "o_orderdate", days=365, k=3,
                           as_of=F.lit("2001-08-01").cast("timestamp")).select("o_orderkey", "o_custkey")


@query("j_13_full_features", f"""WITH {MARKET}, {NEWS}, a AS (SELECT symbol, {R('avg(price)', 4)} AS price_mean FROM market WHERE symbol <> '5-LOW' GROUP BY 1), b AS (SELECT CASE symbol WHEN 'click' THEN '1-URGENT' WHEN 'view' THEN '2-HIGH' ELSE symbol END AS symbol, {R('avg(score)')} AS mood FROM news GROUP BY 1)
 SELECT symbol, coalesce(price_mean, 0.0) AS price_mean, coalesce(mood, 0.0) AS mood FROM a FULL JOIN b USING (symbol)""")
def _(spark, d):
    a = market(spark, d).where("symbol <> '5-LOW'").groupBy("symbol").agg(r(F.avg("price"), 4).alias("price_mean"))
    name = F.when(F.col("symbol") == "click", "1-URGENT").when(F.col("symbol") == "view", "2-HIGH").otherwise(F.col("symbol"))
    b = news(spark, d).groupBy(name.alias("symbol")).agg(r(F.avg("score")).alias("mood"))
    return J.full_features(a, b, ["symbol"])


# -------------------------------------------------------------------------------- aggregates
@query("a_01_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("orders", "customer", "documents", "events", "labels")))
def _(spark, d):
    return A.table_counts({t: table(spark, d, t) for t in ("orders", "customer", "documents", "events", "labels")})


@query("a_01_counts_by", "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return A.counts_by(table(spark, d, "events").withColumn("day", F.to_date("ts")), ["event_type", "day"])


@query("a_02_distribution", f"SELECT lang, source, count(*) AS n, {R('count(*) / sum(count(*)) OVER (PARTITION BY lang) * 100')} AS pct FROM documents GROUP BY 1, 2")
def _(spark, d):
    return rounded(A.distribution(table(spark, d, "documents"), "source", "lang"), "pct")


@query("a_02_distribution_labels", f"SELECT quality, count(*) AS n, {R('count(*) / sum(count(*)) OVER () * 100')} AS pct FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def _(spark, d):
    return rounded(A.distribution(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id"), "quality"), "pct")


@query("a_03_daily_stats", f"WITH {NEWS} SELECT CAST(ts AS DATE) AS day, {R('avg(score)')} AS mean, count(*) AS n FROM news GROUP BY 1")
def _(spark, d):
    return rounded(A.daily_stats(news(spark, d), "ts", "score"), "mean")


@query("a_04_resample_daily", f"""WITH x AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS mean, count(*) AS n FROM orders GROUP BY 1, 2),
 m AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day, o_orderstatus, row_number() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY count(*) DESC, o_orderstatus) AS k FROM orders GROUP BY 1, 2, 3),
 z AS (SELECT symbol, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM x GROUP BY symbol),
 j AS (SELECT symbol, day, mean, coalesce(n, 0) AS n, o_orderstatus FROM z LEFT JOIN x USING (symbol, day) LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (symbol, day))
 SELECT symbol, day, {R('mean')} AS mean, n, o_orderstatus, {R('mean - lag(mean) OVER (PARTITION BY symbol ORDER BY day)')} AS change,
 {R('avg(mean) OVER (PARTITION BY symbol ORDER BY day ROWS 6 PRECEDING)')} AS mean_7d FROM j""")
def _(spark, d):
    df = A.resample_daily(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "symbol"), "symbol", "o_orderdate", "o_totalprice", "o_orderstatus")
    return rounded(df, "mean", "change", "mean_7d")


@query("a_04_resample_filled", f"""WITH x AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS mean, sum(o_totalprice) AS n FROM orders GROUP BY 1, 2),
 m AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day, o_orderstatus, row_number() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY count(*) DESC, o_orderstatus) AS k FROM orders GROUP BY 1, 2, 3),
 z AS (SELECT symbol, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM x GROUP BY symbol),
 j AS (SELECT symbol, day, coalesce(mean, 0.5) AS mean, coalesce(n, 0) AS n, coalesce(o_orderstatus, 'NEUTRAL') AS o_orderstatus FROM z LEFT JOIN x USING (symbol, day) LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (symbol, day))
 SELECT symbol, day, {R('mean', 4)} AS mean, {R('n', 2)} AS n, o_orderstatus, {R('coalesce(mean - lag(mean) OVER (PARTITION BY symbol ORDER BY day), 0)', 4)} AS change,
 {R('avg(mean) OVER (PARTITION BY symbol ORDER BY day ROWS 6 PRECEDING)', 4)} AS mean_7d FROM j""")
def _(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "symbol")
    df = A.resample_daily(orders, "symbol", "o_orderdate", "o_totalprice", "o_orderstatus", total="o_totalprice", fill={"mean": 0.5, "label": "NEUTRAL", "change": 0.0})
    return rounded(df, "mean", "change", "mean_7d", digits=4).withColumn("n", r("n", 2))


@query("a_05_profile", f"""SELECT l_returnflag, {R('avg(l_extendedprice)', 4)} AS mean, min(l_extendedprice) AS minimum, max(l_extendedprice) AS maximum, count(*) FILTER (l_extendedprice > 50000) AS n_high,
 count(*) FILTER (l_extendedprice < 10000) AS n_low, count(*) AS n, {R('quantile_cont(l_extendedprice, 0.5)', 4)} AS median FROM lineitem GROUP BY 1""")
def _(spark, d):
    df = A.profile(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag", high=50000, low=10000)
    return rounded(df, "mean", "median", digits=4)


@query("a_05_profile_all", f"""SELECT {R('avg(c_acctbal)', 4)} AS mean, min(c_acctbal) AS minimum, max(c_acctbal) AS maximum, count(*) FILTER (c_acctbal > 70) AS n_high,
 count(*) FILTER (c_acctbal < 30) AS n_low, count(*) AS n, {R('quantile_cont(c_acctbal, 0.5)', 4)} AS median FROM customer""")
def _(spark, d):
    return rounded(A.profile(table(spark, d, "customer"), "c_acctbal"), "mean", "median", digits=4)


@query("a_06_group_mean_extremes", f"WITH x AS (SELECT source, avg(n_chars) AS m FROM documents GROUP BY 1) SELECT arg_max(source, (m, source)) AS best, {R('max(m)', 4)} AS best_mean, arg_min(source, (m, source)) AS worst, {R('min(m)', 4)} AS worst_mean FROM x")
def _(spark, d):
    return rounded(A.group_mean_extremes(table(spark, d, "documents"), "source", "n_chars"), "best_mean", "worst_mean", digits=4)


@query("a_07_label_pivot_daily", f"""WITH {NEWS} SELECT CAST(ts AS DATE) AS day, count(*) FILTER (label = 'POSITIVE') AS positive, count(*) FILTER (label = 'NEUTRAL') AS neutral,
 count(*) FILTER (label = 'NEGATIVE') AS negative, count(*) AS total FROM news GROUP BY 1 ORDER BY 1 DESC LIMIT 7""")
def _(spark, d):
    return A.label_pivot_daily(news(spark, d), "ts", "label", ["POSITIVE", "NEUTRAL", "NEGATIVE"])


@query("a_08_pivot_series", f"WITH {OHLC} SELECT day, " + ", ".join(f"max(close) FILTER (symbol = '{p}') AS \"{p}\"" for p in PRIORITIES) + " FROM ohlc GROUP BY day")
def _(spark, d):
    return A.pivot_series(ohlc(spark, d), "day", "symbol", "close", PRIORITIES)


@query("a_09_kpis", f"""WITH {MARKET}, {NEWS}, c AS (SELECT symbol, max(market_cap) AS cap FROM market GROUP BY 1)
 SELECT {R('(SELECT sum(cap) FROM c)', 2)} AS total_cap, (SELECT count(*) FROM c) AS assets, {R('avg(price_change_24h)')} AS mean_change, {R('(SELECT avg(score) * 100 FROM news)')} AS sentiment_pct,
 CASE WHEN avg(price_change_24h) >= 0 THEN 'up' ELSE 'down' END AS trend FROM market""")
def _(spark, d):
    df = A.kpis(market(spark, d), news(spark, d), score="score")
    return rounded(df, "mean_change", "sentiment_pct").withColumn("total_cap", r(F.col("total_cap"), 2))


@query("a_10_share_of_total", f"WITH {MARKET}, c AS (SELECT symbol, max(market_cap) AS amount FROM market GROUP BY 1) SELECT symbol, amount, round(amount / sum(amount) OVER () * 100, 2) AS share FROM c")
def _(spark, d):
    return A.share_of_total(market(spark, d), "symbol", "market_cap")


@query("a_11_explode_counts", f"WITH {WALLETS} SELECT item, count(*) AS n FROM (SELECT unnest(security_features) AS item FROM wallets) GROUP BY 1 ORDER BY n DESC, item LIMIT 3")
def _(spark, d):
    return A.explode_counts(wallets(spark, d), "security_features", 3)


@query("a_12_distinct_stats", "SELECT event_type, count(DISTINCT user_id) AS n_user_id, count(DISTINCT CAST(ts AS DATE)) AS n_day FROM events GROUP BY 1")
def _(spark, d):
    return A.distinct_stats(table(spark, d, "events").withColumn("day", F.to_date("ts")), ["user_id", "day"], by="event_type")


@query("a_13_global_stats", f"""WITH {WALLETS} SELECT count(*) AS n, CAST(sum(transaction_count) AS BIGINT) AS sum_transaction_count, {R('avg(balance)', 4)} AS avg_balance, {R('avg(active_days)')} AS avg_active_days,
 {R('sum(contract_interactions) * 100.0 / (sum(contract_interactions) + sum(active_days))')} AS pct_contract_interactions, {R('sum(active_days) * 100.0 / (sum(contract_interactions) + sum(active_days))')} AS pct_active_days FROM wallets""")
def _(spark, d):
    df = A.global_stats(wallets(spark, d), ["transaction_count"], ["balance", "active_days"], ["contract_interactions", "active_days"])
    return rounded(df, "avg_active_days", "pct_contract_interactions", "pct_active_days").withColumn("avg_balance", r(F.col("avg_balance"), 4))


@query("a_14_weighted_mean", f"WITH {WALLETS} SELECT fund, {R('CASE WHEN sum(balance) > 0 THEN sum(risk_score * balance) / sum(balance) ELSE avg(risk_score) END')} AS weighted_mean FROM wallets GROUP BY 1")
def _(spark, d):
    return rounded(A.weighted_mean(wallets(spark, d), "risk_score", "balance", "fund"), "weighted_mean")


CORR_WORDS = """CASE WHEN abs(c) > 0.7 THEN 'strong' WHEN abs(c) > 0.4 THEN 'moderate' WHEN abs(c) > 0.2 THEN 'weak' ELSE 'negligible' END || CASE WHEN c < 0 THEN ' negative' ELSE ' positive' END"""


@query("a_15_correlate", f"WITH x AS (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS c, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_returnflag, {R('c')} AS correlation, n, {CORR_WORDS} AS strength FROM x")
def _(spark, d):
    return rounded(A.correlate(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag"), "correlation")


@query("a_16_linear_fit", f"SELECT l_returnflag, {R('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope, {R('regr_intercept(l_extendedprice, l_quantity)', 3)} AS intercept, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    df = A.linear_fit(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")
    return rounded(rounded(df, "slope", digits=4), "intercept", digits=3)


@query("a_17_collect_distinct", f"WITH {WALLETS} SELECT fund, array_to_string(list_sort(list_distinct(flatten(list(risk_factors)))), '|') AS factors FROM wallets GROUP BY 1")
def _(spark, d):
    factors = wallets(spark, d).select("fund", F.explode("risk_factors").alias("factor"))
    return A.collect_distinct(factors, "fund", "factor").select("fund", F.array_join("values", "|").alias("factors"))


@query("a_18_summary_extremes", f"""WITH {WALLETS}, x AS (SELECT address, CASE WHEN wallet_id % 10 <> 0 THEN risk_score END AS score FROM wallets)
 SELECT count(*) AS n, count(score) AS n_scored, round(avg(score), 2) AS mean_score, arg_max(address, (score, address)) FILTER (score IS NOT NULL) AS highest, max(score) AS highest_score,
 arg_min(address, (score, address)) FILTER (score IS NOT NULL) AS lowest, min(score) AS lowest_score FROM x""")
def _(spark, d):
    df = wallets(spark, d).select("address", F.when(F.col("wallet_id") % 10 != 0, F.col("risk_score")).alias("score"))
    return A.summary_extremes(df, "address", "score")


@query("a_19_prevalence", f"""WITH {WALLETS}, x AS (SELECT factor, count(*) AS n FROM (SELECT wallet_id, unnest(list_distinct(risk_factors)) AS factor FROM wallets) GROUP BY 1), y AS (SELECT *, n * 100.0 / (SELECT count(*) FROM wallets) AS p FROM x)
 SELECT factor, n, {R('p')} AS prevalence, CASE WHEN p > 70 THEN 'High' WHEN p > 30 THEN 'Medium' ELSE 'Low' END AS severity FROM y""")
def _(spark, d):
    return rounded(A.prevalence(wallets(spark, d), "wallet_id", "risk_factors"), "prevalence")


@query("a_20_type_distribution", f"WITH {WALLETS} SELECT wallet_type AS type, count(*) AS n, {R('sum(balance)', 2)} AS balance, {R('sum(balance) / sum(sum(balance)) OVER () * 100')} AS percentage FROM wallets GROUP BY 1")
def _(spark, d):
    return rounded(rounded(A.type_distribution(wallets(spark, d), "wallet_type", "balance"), "percentage"), "balance", digits=2)


@query("a_21_histogram", f"""WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), c AS (SELECT CAST(least(floor((o_totalprice - lo) / (hi - lo) * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM orders, e GROUP BY 1)
 SELECT CAST(b AS INTEGER) AS bin, {R('lo + b * (hi - lo) / 10', 4)} AS bin_start, coalesce(n, 0) AS n FROM e, range(0, 10) t(b) LEFT JOIN c ON c.bin = b""")
def _(spark, d):
    return rounded(A.histogram(table(spark, d, "orders"), "o_totalprice"), "bin_start", digits=4)


@query("a_21_category_counts", "WITH l(position, category) AS (VALUES (0, '1-URGENT'), (1, '5-LOW'), (2, 'Error')) SELECT position, category, count(o_orderkey) AS n FROM l LEFT JOIN orders ON o_orderpriority = category GROUP BY 1, 2")
def _(spark, d):
    return A.category_counts(table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "5-LOW", "Error"])


# ----------------------------------------------------------------------------------- ranking
@query("k_01_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark, d):
    return K.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 25, tie=[F.col("o_orderkey")])


@query("k_02_arg_extreme", "(SELECT 'best' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) UNION ALL (SELECT 'worst', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1)")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    best = K.arg_extreme(o, "o_totalprice", tie=[F.col("o_orderkey")]).select(F.lit("best").alias("side"), "*")
    return best.unionByName(K.arg_extreme(o, "o_totalprice", largest=False, tie=[F.col("o_orderkey")]).select(F.lit("worst").alias("side"), "*"))


@query("k_03_page", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def _(spark, d):
    return K.page(table(spark, d, "orders"), sort="o_orderdate", limit=20, offset=40, status="O", status_col="o_orderstatus", tie=[F.col("o_orderkey")]).select("o_orderkey", "o_orderdate")


@query("k_03_deep_page", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 50 OFFSET 4321")
def _(spark, d):
    """A third of the way down at the smallest scale; only the ranges around the page are sorted."""
    rows = K.deep_page(table(spark, d, "lineitem"), sort="l_shipdate", limit=50, offset=4321, tie=[F.col("l_orderkey"), F.col("l_linenumber")])
    return rows.select("l_orderkey", "l_linenumber", "l_shipdate")


@query("k_04_percentile_band", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= (SELECT quantile_disc(o_totalprice, 0.75) FROM orders)")
def _(spark, d):
    return K.percentile_band(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "p75")


@query("k_05_top_k_per", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def _(spark, d):
    df = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return K.top_k_per(df, "l_suppkey", "l_extendedprice", 3, tie=[F.col("l_orderkey"), F.col("l_linenumber")])


@query("k_06_mode_per", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) = 1")
def _(spark, d):
    return K.mode_per(table(spark, d, "events"), "user_id", "event_type")


# ------------------------------------------------------------------------------------ set ops
@query("d_01_append", "SELECT event_id, ts, value, NULL::BIGINT AS o_orderkey FROM events UNION ALL SELECT NULL, o_orderdate, o_totalprice, o_orderkey FROM orders")
def _(spark, d):
    a = table(spark, d, "events").select("event_id", "ts", "value")
    b = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"))
    return D.append(a, b)


@query("d_02_intersect_difference", "SELECT 'both' AS side, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def _(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return D.intersect(a, b).select(F.lit("both").alias("side"), "k").unionByName(D.difference(a, b).select(F.lit("only").alias("side"), "k"))


@query("d_03_dedupe_first", "SELECT o_custkey, o_orderdate, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1")
def _(spark, d):
    return D.dedupe_first(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderdate", "o_orderkey")


@query("d_04_distinct", "SELECT doc_id, n_words FROM (SELECT doc_id, text, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS n_words, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def _(spark, d):
    from tidemark.functions.texts import words
    df = D.distinct_by(table(spark, d, "documents"), "text", [F.col("doc_id")])
    return df.select("doc_id", F.size(D.distinct_ordered(words("text"))).cast("long").alias("n_words"))


@query("d_05_duplicate_keys", "SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return D.duplicate_keys(table(spark, d, "orders"), ["o_custkey", "o_orderdate"])


@query("d_06_diff_content", """WITH b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN text || ' old' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 2), a AS (SELECT doc_id, text FROM documents WHERE doc_id % 5 <> 3)
 SELECT doc_id, CASE WHEN b.text IS NULL THEN 'new' WHEN a.text IS NULL THEN 'deleted' WHEN a.text = b.text THEN 'unchanged' ELSE 'modified' END AS status, sha256(a.text) AS hash, sha256(b.text) AS old_hash FROM a FULL JOIN b USING (doc_id)""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 5
    before = docs.where(k != 2).withColumn("text", F.when(k == 1, F.concat("text", F.lit(" old"))).otherwise(F.col("text")))
    return D.diff_content(docs.where(k != 3), before, "doc_id", "text")


TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


@query("d_07_article_id", f"SELECT md5(url || '_' || {TITLE}) AS article_id, page_id FROM pages QUALIFY row_number() OVER (PARTITION BY md5(url || '_' || {TITLE}) ORDER BY page_id) = 1")
def _(spark, d):
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    df = table(spark, d, "pages").select("page_id", "url", title.alias("title"))
    return D.dedupe_articles(df, "url", "title", [F.col("page_id")]).select("article_id", "page_id")


@query("d_08_dedupe_normalized", """WITH s AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '\\n'))) AS line FROM documents), n AS (SELECT line, min(doc_id) AS doc_id, md5(trim(regexp_replace(lower(line), '\\s+', ' ', 'g'))) AS h FROM s WHERE line <> '' GROUP BY line)
 SELECT doc_id, line FROM n QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, line) = 1""")
def _(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line")).where("line <> ''")
    return D.dedupe_normalized(lines, [], "line", [F.col("doc_id"), F.col("line")]).select("doc_id", "line")


@query("d_09_needs_processing", "SELECT doc_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 4 = 1 OR doc_id % 3 = 0")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    k = F.col("doc_id")
    tracker = docs.where(k % 4 != 0).select("doc_id", F.when(k % 4 == 1, F.lit("stale")).otherwise(F.col("hash")).alias("hash"), (k % 3 != 0).alias("success"))
    return D.needs_processing(docs, tracker, "doc_id").select("doc_id")


# ------------------------------------------------------------------------------ the flagship
@query("flagship_market_overview", f"""WITH {OHLC}, x AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS rt, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS age FROM ohlc),
 y AS (SELECT symbol, rt, row_number() OVER (PARTITION BY symbol ORDER BY age DESC) AS i FROM x WHERE age <= 90)
 SELECT symbol, max(day) AS day, arg_max(close, day) AS close, (SELECT {R('stddev_samp(rt) * 100')} FROM y WHERE y.symbol = x.symbol AND i > 1) AS daily_volatility, {R('(arg_max(close, day) / max(close) - 1) * 100')} AS current_drawdown_pct FROM x GROUP BY symbol""")
def _(spark, d):
    bars = ohlc(spark, d)
    latest = S.latest_per_key(bars, "symbol", "day").select("symbol", "day", "close")
    vol = S.volatility(bars, "symbol", "day", "close").select("symbol", r("daily_volatility"))
    top = S.high_low_drawdown(bars, "symbol", "day", "close", 1).select("symbol", r("current_drawdown_pct"))
    return latest.join(vol, "symbol").join(top, "symbol")
