"""Wallets, transactions, tokens and funds.

Every profile is built from sums that combine on the map side. Where a wallet's
distinct partners are needed, rows first shrink to one per (wallet, partner), so a
wallet with a large share of all transactions spreads over its partners.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import lexicons as L
from tidemark import scale
from tidemark.functions.dates import days_between
from tidemark.functions.ladders import above, three_level, wallet_level
from tidemark.functions.numbers import clamp
from tidemark.operators import series


def sides(txs: DataFrame, *, sender: str = "sender", recipient: str = "recipient") -> DataFrame:
    """Each transaction once per involved wallet, with its partner (null for a transfer to oneself) and direction."""
    s, t = F.col(sender), F.col(recipient)
    own = s == t
    roles = F.array_compact(F.array(
        F.struct(t.alias("address"), F.when(~own, s).alias("partner"), F.lit("in").alias("direction"), own.alias("sent_by_self")),
        F.when(~own, F.struct(s.alias("address"), t.alias("partner"), F.lit("out").alias("direction"), F.lit(True).alias("sent_by_self")))))
    return txs.withColumn("_role", F.explode(roles)).select("*", "_role.address", "_role.partner", "_role.direction", "_role.sent_by_self").drop("_role")


def wallet_profile(txs: DataFrame, token_txs: DataFrame | None = None, *, value: str = "value", ts: str = "ts", data: str = "input", token: str = "token") -> DataFrame:
    """Counts, totals, activity span, partners, contracts and token variety per wallet."""
    rows = sides(txs)
    called = F.col("sent_by_self") & (F.col(data) != "0x")
    partners = rows.groupBy("address", "partner").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("direction") == "in", F.col(value)).otherwise(0.0)).alias("_in"),
        F.sum(F.when(F.col("direction") == "out", F.col(value)).otherwise(0.0)).alias("_out"), F.min(ts).alias("_a"), F.max(ts).alias("_b"),
        F.count_if(called).alias("_calls"))
    out = partners.groupBy("address").agg(
        F.sum("_n").alias("transaction_count"), F.sum("_in").alias("total_received"), F.sum("_out").alias("total_sent"), F.min("_a").alias("first_activity"),
        F.max("_b").alias("last_activity"), F.count("partner").alias("unique_interactions"), F.sum("_calls").alias("contract_interactions"),
        F.count_if(F.col("_calls") > 0).alias("unique_contracts"))
    age = (F.col("last_activity").cast("timestamp").cast("double") - F.col("first_activity").cast("timestamp").cast("double")) / 86400
    out = out.withColumn("age_days", age)
    if token_txs is None:
        return out.withColumn("token_variety", F.lit(0).cast("long")).withColumn("token_transaction_count", F.lit(0).cast("long"))
    held = sides(token_txs).groupBy("address", token).agg(F.count(F.lit(1)).alias("_n")).groupBy("address").agg(
        F.count(F.lit(1)).alias("token_variety"), F.sum("_n").alias("token_transaction_count"))
    return out.join(held, "address", "left").fillna(0, subset=["token_variety", "token_transaction_count"])


def wallet_risk(profiles: DataFrame) -> DataFrame:
    """Risk score from age, activity, contracts, partners and tokens, with level and factors."""
    age, n = F.col("age_days"), F.col("transaction_count")
    contracts, partners, variety = F.col("unique_contracts"), F.col("unique_interactions"), F.col("token_variety")
    score = (F.lit(50) + F.when(age < 30, 20).when(age < 180, 10).when(age > 365, -10).otherwise(0) + F.when(n < 5, 15).when(n > 1000, 5).otherwise(0)
             + F.when(contracts == 0, -5).when(contracts > 20, -10).otherwise(0) + F.when(partners < 3, 15).when(partners > 50, -10).otherwise(0)
             + F.when(variety > 10, -5).otherwise(0))
    factors = F.array_compact(F.array(
        F.when(age < 30, "Recently created wallet"), F.when(n < 5, "Very few transactions"), F.when(partners < 3, "Limited interaction network"),
        F.when(contracts == 0, "No interaction with smart contracts")))
    return profiles.withColumn("risk_score", clamp(score)).withColumn("risk_level", wallet_level("risk_score")).withColumn("risk_factors", factors)


def tx_stats(txs: DataFrame, by: str | Sequence[str], *, value: str = "value", ts: str = "ts", error: str = "is_error", gas: str = "gas_price") -> DataFrame:
    """Count, value totals, success rate, errors, mean gas and activity span."""
    ok = F.count_if(F.col(error) == "0")
    n = F.count(F.lit(1))
    return txs.groupBy(*scale.as_keys(by)).agg(
        n.alias("n"), F.sum(value).alias("total_value"), F.avg(value).alias("average_value"), F.max(value).alias("max_value"), (ok / n * 100).alias("success_rate"),
        (n - ok).alias("error_count"), F.avg(gas).alias("avg_gas"), F.min(ts).alias("first_tx"), F.max(ts).alias("last_tx"))


def tx_patterns(txs: DataFrame, by: str | Sequence[str], *, data: str = "input", recipient: str = "recipient") -> DataFrame:
    """Share of plain transfers and contract calls and the most frequent recipient (smallest on a tie)."""
    names = scale.as_keys(by)
    pairs = txs.groupBy(*names, recipient).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(data) == "0x").alias("_plain"))
    shares = pairs.groupBy(*names).agg((F.sum("_plain") / F.sum("_n") * 100).alias("transfer_pct"),
                                       ((F.sum("_n") - F.sum("_plain")) / F.sum("_n") * 100).alias("contract_pct"))
    top = scale.top_per_key(pairs.where(F.col(recipient).isNotNull()), names, [F.col("_n").desc(), F.col(recipient)], 1)
    return shares.join(top.select(*names, F.col(recipient).alias("top_recipient"), F.col("_n").alias("top_count")), names, "left")


def tx_risk_indicators(txs: DataFrame, by: str, *, value: str = "value", ts: str = "ts", error: str = "is_error", large: float = 10.0, failed_pct: float = 20.0,
                       burst: int = 5, seconds: int = 3600) -> DataFrame:
    """(key, indicator, severity, amount): large transfers, high failure rate and bursts."""
    stats = txs.groupBy(by).agg(F.count_if(F.col(value) > large).alias("_large"), (F.count_if(F.col(error) == "1") / F.count(F.lit(1)) * 100).alias("_failed"),
                                F.count(F.lit(1)).alias("_n"))
    quick = series.bursts(txs, by, ts, burst, seconds).groupBy(by).agg(F.count(F.lit(1)).alias("_bursts"))
    both = stats.join(quick, by, "left")
    rows = F.array_compact(F.array(
        F.when(F.col("_large") > 0, F.struct(F.lit("large_transactions").alias("indicator"), F.lit("medium").alias("severity"), F.col("_large").cast("double").alias("amount"))),
        F.when(F.col("_failed") > failed_pct, F.struct(F.lit("high_failure_rate").alias("indicator"), F.lit("medium").alias("severity"), F.col("_failed").alias("amount"))),
        F.when((F.col("_n") > burst) & (F.col("_bursts") > 0), F.struct(F.lit("burst_activity").alias("indicator"), F.lit("low").alias("severity"), F.col("_bursts").cast("double").alias("amount")))))
    return both.select(by, F.explode(rows).alias("_i")).select(by, "_i.*")


def token_ledger(token_txs: DataFrame, k: int | None = None, *, token: str = "token", value: str = "value", ts: str = "ts") -> DataFrame:
    """Transfers and volume in and out, first and last sight and holding days per wallet and token; ``k`` keeps the busiest tokens."""
    come, go = F.col("direction") == "in", F.col("direction") == "out"
    out = sides(token_txs).groupBy("address", token).agg(
        F.count_if(come).alias("transfers_in"), F.count_if(go).alias("transfers_out"), F.sum(F.when(come, F.col(value)).otherwise(0.0)).alias("volume_in"),
        F.sum(F.when(go, F.col(value)).otherwise(0.0)).alias("volume_out"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
    held = (F.col("last_seen").cast("timestamp").cast("double") - F.col("first_seen").cast("timestamp").cast("double")) / 86400
    out = out.withColumn("holding_days", held)
    if k is None:
        return out
    return scale.top_per_key(out, "address", [(F.col("transfers_in") + F.col("transfers_out")).desc(), F.col(token)], k, rank="rank")


def token_category(df: DataFrame, symbol: str, categories: Mapping[str, Sequence[str]] = L.TOKEN_CATEGORIES) -> DataFrame:
    """Token group of each symbol."""
    out = F.when(F.lit(False), "")
    for name, symbols in categories.items():
        out = out.when(F.col(symbol).isin(list(symbols)), name)
    return df.withColumn("token_category", out.otherwise("other"))


def fund_rollup(wallets: DataFrame, fund: str = "fund", *, tokens: str | None = None, k: int = 5) -> DataFrame:
    """Totals, mean risk and level, wallets per level, risk factors and most held tokens per fund."""
    level = three_level("risk_score")
    out = wallets.groupBy(fund).agg(
        F.count(F.lit(1)).alias("wallets"), F.sum("balance").alias("total_balance"), F.sum("transaction_count").alias("total_transactions"),
        F.avg("risk_score").alias("average_risk"), F.count_if(level == "High").alias("high_risk"), F.count_if(level == "Medium").alias("medium_risk"),
        F.count_if(level == "Low").alias("low_risk")).withColumn("risk_level", three_level("average_risk"))
    factors = wallets.select(fund, F.explode("risk_factors").alias("_f")).distinct().groupBy(fund).agg(F.array_sort(F.collect_list("_f")).alias("risk_factors"))
    out = out.join(factors, fund, "left")
    if tokens is None:
        return out
    held = wallets.select(fund, F.explode(tokens).alias("token")).groupBy(fund, "token").agg(F.count(F.lit(1)).alias("_n"))
    best = scale.top_per_key(held, fund, [F.col("_n").desc(), F.col("token")], k, rank="_r")
    top = best.groupBy(fund).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "token"))), lambda s: s["token"]).alias("top_tokens"))
    counts = held.groupBy(fund).agg(F.count(F.lit(1)).alias("token_count"))
    return out.join(top, fund, "left").join(counts, fund, "left")


def activity_level(wallets: DataFrame, as_of: Column) -> DataFrame:
    """Dormant after 90 days of silence, else High above 5 and Medium above 1 transactions per active day."""
    rate = F.when(F.col("active_days") > 0, F.col("transaction_count") / F.col("active_days")).otherwise(0.0)
    silent = days_between(as_of.cast("timestamp"), F.col("last_activity").cast("timestamp"))
    return wallets.withColumn("activity_frequency", rate).withColumn(
        "activity_level", F.when(silent > 90, "Dormant").otherwise(above(F.col("activity_frequency"), [(5, "High"), (1, "Medium")], "Low")))


def concentration(df: DataFrame, group: str | Sequence[str], amount: str) -> DataFrame:
    """Largest share, Herfindahl index, normalised diversification and concentration class per group.

    HHI = sum(x^2) / sum(x)^2, so one pass of sums is enough.
    """
    x = F.col(amount).cast("double")
    out = df.groupBy(*scale.as_keys(group)).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("_s"), F.sum(x * x).alias("_q"), F.max(x).alias("_m"))
    good = F.col("_s") > 0
    out = out.withColumn("hhi", F.when(good, F.col("_q") / (F.col("_s") * F.col("_s")))).withColumn(
        "largest_pct", F.when(good, F.col("_m") / F.col("_s") * 100).otherwise(0.0))
    floor = 1 / F.col("n")
    score = F.when(~good, 0.0).when(F.col("n") > 1, 100 * (1 - (F.col("hhi") - floor) / (1 - floor))).otherwise(50.0)
    level = F.when(~good, "Unknown").otherwise(above(F.col("largest_pct"), [(80, "High"), (50, "Medium")], "Low"))
    return out.withColumn("diversification_score", score).withColumn("concentration_risk", level).drop("_s", "_q", "_m")


def pattern_assessment(wallets: DataFrame, group: str) -> DataFrame:
    """Activity mix of a group's wallets: unusual patterns, risk score and level (needs :func:`activity_level`)."""
    pct = F.when(F.col("transaction_count") > 0, F.col("contract_interactions") / F.col("transaction_count") * 100)
    out = wallets.groupBy(group).agg(
        F.avg(F.when(F.col("activity_level") == "Dormant", 1.0).otherwise(0.0)).alias("dormant_share"),
        F.avg(F.when(F.col("activity_level") == "High", 1.0).otherwise(0.0)).alias("busy_share"),
        F.avg("activity_frequency").alias("avg_frequency"), F.coalesce(F.avg(pct), F.lit(0.0)).alias("avg_contract_pct"))
    unusual = F.array_compact(F.array(
        F.when(F.col("dormant_share") > 0.3, "High percentage of inactive wallets"), F.when(F.col("busy_share") > 0.3, "High percentage of very active wallets"),
        F.when(F.col("avg_contract_pct") > 70, "High percentage of contract interactions")))
    return (out.withColumn("unusual_patterns", unusual).withColumn("pattern_risk_score", clamp(50.0 + F.size("unusual_patterns") * 10))
            .withColumn("pattern_risk_level", three_level("pattern_risk_score"))
            .withColumn("frequency_class", F.when(F.col("avg_frequency") > 3, "High").when(F.col("avg_frequency") < 0.5, "Low").otherwise("Normal")))


# Security features with their points and what to advise when none has them.
SECURITY_POINTS = {"Multi-sig": (40, "Implement multi-signature security for all wallets"), "Hardware Security": (30, "Use hardware wallets for cold storage"),
                   "Time-locked": (15, "Consider time-locks for large withdrawals"), "Daily limits": (15, "Set daily transaction limits")}


def security_coverage(wallets: DataFrame, group: str, features: str = "security_features") -> DataFrame:
    """Points for present features minus ten per feature below 50 % coverage, with recommendations."""
    sizes = wallets.groupBy(group).agg(F.count(F.lit(1)).alias("wallets"))
    counts = wallets.select(group, F.explode(features).alias("feature")).groupBy(group, "feature").agg(F.count(F.lit(1)).alias("_n"))
    points = F.lit(0)
    for name, (value, _) in SECURITY_POINTS.items():
        points = F.when(F.col("feature") == name, value).otherwise(points)
    per = counts.join(sizes, group).groupBy(group).agg(
        F.sum(points).alias("_p"), F.count_if(F.col("_n") / F.col("wallets") * 100 < 50).alias("_thin"), F.collect_set("feature").alias("_have"))
    out = sizes.join(per, group, "left").withColumn("security_score", clamp(F.coalesce(F.col("_p") - 10 * F.col("_thin"), F.lit(0))))
    have = F.coalesce("_have", F.array().cast("array<string>"))
    advice = F.array_compact(F.array(*[F.when(~F.array_contains(have, n), F.lit(text)) for n, (_, text) in SECURITY_POINTS.items()]))
    return out.withColumn("recommendations", advice).drop("_p", "_thin", "_have")


def feature_coverage(wallets: DataFrame, group: str, features: str = "security_features") -> DataFrame:
    """(group, feature, coverage in percent of the group's wallets)."""
    sizes = wallets.groupBy(group).agg(F.count(F.lit(1)).alias("_w"))
    counts = wallets.select(group, F.explode(features).alias("feature")).groupBy(group, "feature").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(sizes, group).select(group, "feature", "n", (F.col("n") / F.col("_w") * 100).alias("coverage_pct"))


def attribute_risk(wallets: DataFrame) -> DataFrame:
    """Risk from age, activity, security features, type and factors."""
    age, n = F.col("age_days"), F.col("transaction_count")
    score = (F.lit(50.0) + F.when(age > 365, -10).when(age < 30, 15).otherwise(0) + F.when(n > 1000, -5).when(n < 10, 10).otherwise(0)
             - F.least(F.lit(20), F.size("security_features") * 5)
             + F.when(F.col("wallet_type") == "Cold Storage", -15).when(F.col("wallet_type") == "Hot Wallet", 5).otherwise(0) + F.size("risk_factors") * 5)
    return wallets.withColumn("attribute_score", clamp(score)).withColumn("attribute_level", three_level("attribute_score"))


def exposure(holdings: DataFrame, tokens: DataFrame | None = None, *, fund: str = "fund", asset: str = "asset", token: str = "token",
             names: Sequence[tuple[str, Sequence[str]]] = tuple(L.EXPOSURE_NAMES), token_map: Mapping[str, str] = L.EXPOSURE_TOKENS) -> DataFrame:
    """(fund, assets): what holdings and wallet tokens imply, sorted."""
    low = F.lower(asset)
    implied = F.when(F.lit(False), "")
    for name, words in names:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        implied = implied.when(hit, name)
    rows = holdings.select(fund, implied.alias("exposed"))
    if tokens is not None:
        pairs = F.create_map(*[F.lit(x) for p in token_map.items() for x in p])
        rows = rows.unionByName(tokens.select(fund, F.try_element_at(pairs, F.lower(token)).alias("exposed")))
    return rows.where(F.col("exposed").isNotNull()).distinct().groupBy(fund).agg(F.array_sort(F.collect_list("exposed")).alias("exposure"))
