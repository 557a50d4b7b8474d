"""Cleaning, validation and data-quality reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark import scale
from tidemark.functions.dates import days_between, parse_date_any
from tidemark.functions.ladders import above
from tidemark.functions.numbers import clamp, parse_aum_millions, parse_fraction
from tidemark.functions.symbols import is_eth_address
from tidemark.operators import aggregates, series, setops


def clean_ohlcv(df: DataFrame, key: str, ts: str, *, tie: Sequence[Column] = (), min_rows: int = 5) -> DataFrame:
    """De-duplicate, drop closes outside median - 3*IQR / + 5*IQR, cap volume at median + 10*IQR, repair high and low.

    Bounds apply to series with more than ``min_rows`` rows.
    """
    qs = {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}
    both = scale.percentiles_of(df, key, ["close", "volume"], qs)
    both = both.select(key, *[F.col(f"{c}.{k}").alias(f"_{c[0]}{k}") for c in ("close", "volume") for k in qs])
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    unique = setops.dedupe_first(df, [key, ts], [F.col(ts), *tie])
    out = unique.join(n, key).join(both, key, "left")
    bounded = F.col("_n") > min_rows
    iqr = F.col("_c_q3") - F.col("_c_q1")
    low, high = F.greatest(F.lit(0.0), F.col("_c_q2") - 3 * iqr), F.col("_c_q2") + 5 * iqr
    cap = F.col("_v_q2") + 10 * (F.col("_v_q3") - F.col("_v_q1"))
    out = out.where(~bounded | F.col("close").between(low, high)).withColumn("volume", F.greatest(F.lit(0.0), F.when(bounded, F.least("volume", cap)).otherwise(F.col("volume"))))
    out = out.withColumn("_h", F.greatest("open", "high", "low", "close")).withColumn("_l", F.least("open", "high", "low", "close"))
    return out.withColumn("high", F.col("_h")).withColumn("low", F.col("_l")).select(*df.columns)


def series_issues(df: DataFrame, key: str, ts: str, as_of: Column, *, close: str = "close", volume: str = "volume") -> DataFrame:
    """Issues per series: few rows, date gaps, short span, stale, zero prices, mostly zero volume."""
    stats = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_a"), F.max(ts).alias("_b"), F.count_if(F.col(close) == 0).alias("_zp"), F.count_if(F.col(volume) == 0).alias("_zv"))
    holes = series.gaps(df, key, ts, 7).groupBy(key).agg(F.count(F.lit(1)).alias("_g"))
    x = stats.join(holes, key, "left").withColumn("_g", F.coalesce("_g", F.lit(0)))
    a, b = F.col("_a").cast("timestamp"), F.col("_b").cast("timestamp")
    old = days_between(as_of.cast("timestamp"), b)
    issues = F.array_compact(F.array(
        F.when(F.col("_n") < 10, F.concat(F.lit("limited data: "), "_n")), F.when(F.col("_g") > 0, F.concat(F.lit("date gaps: "), "_g")),
        F.when(days_between(b, a) < 30, F.concat(F.lit("short period: "), days_between(b, a))), F.when(old > 30, F.concat(F.lit("not recent: "), old)),
        F.when(F.col("_zp") > 0, F.concat(F.lit("zero prices: "), "_zp")), F.when(F.col("_zv") > F.col("_n") * 0.5, F.concat(F.lit("zero volumes: "), "_zv"))))
    return x.select(key, issues.alias("issues"))


def completeness(tables: Mapping[str, DataFrame], thresholds: Mapping[str, Sequence[int]]) -> DataFrame:
    """Excellent / Good / Fair / Poor per table: its count against three descending thresholds."""
    out = aggregates.table_counts(tables)
    grade = F.when(F.lit(False), "")
    for name, (best, good, fair) in thresholds.items():
        grade = grade.when(F.col("table_name") == name, above(F.col("n"), [(best, "Excellent"), (good, "Good"), (fair, "Fair")], "Poor"))
    return out.withColumn("grade", grade)


def table_issues(series_df: DataFrame, key: str, ts: str, news: DataFrame, label: str, as_of: Column, *, stale_days: int = 7, neutral_pct: float = 80) -> DataFrame:
    """Duplicate keys, staleness and label skew as rows (issue, amount)."""
    dup = setops.duplicate_keys(series_df, [key, ts]).agg(F.count(F.lit(1)).cast("double").alias("amount")).select(F.lit("duplicate keys").alias("issue"), "amount").where("amount > 0")
    stale = series_df.agg(days_between(as_of.cast("timestamp"), F.max(ts).cast("timestamp")).cast("double").alias("amount")).select(F.lit("stale").alias("issue"), "amount").where(F.col("amount") > stale_days)
    skew = news.agg((F.count_if(F.col(label) == "NEUTRAL") / F.count(F.lit(1)) * 100).alias("amount")).select(F.lit("neutral share").alias("issue"), "amount").where(F.col("amount") > neutral_pct)
    return dup.unionByName(stale).unionByName(skew)


def coverage(df: DataFrame, key: str, ts: str) -> DataFrame:
    """First and last date, span in days and number of distinct keys."""
    per = df.groupBy(key).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"), F.count(F.lit(1)).alias("_n"))
    return per.agg(F.min("_a").alias("first"), F.max("_b").alias("last"), F.count(F.lit(1)).alias("keys"), F.sum("_n").alias("n")).withColumn(
        "span_days", F.datediff("last", "first").cast("long"))


def check_schemas(expected: Mapping[str, StructType], actual: Mapping[str, DataFrame]) -> DataFrame:
    """(table, column, problem, n_failed) for missing tables, missing columns, other types and values that do not fit the declared type.

    ``n_failed`` counts the rows whose value the declared type can't hold (all rows for a missing
    column), in one aggregate per table.
    """
    spark = next(iter(actual.values())).sparkSession
    schema = "table_name string, column_name string, problem string, n_failed long"
    out = spark.createDataFrame([(name, None, "missing table", None) for name in expected if name not in actual], schema)
    for name, want in expected.items():
        if name not in actual:
            continue
        df, rows = actual[name], []
        have = {f.name: f.dataType for f in df.schema}
        for f in want:
            if f.name not in have:
                problem, failed = F.lit("missing column"), F.count(F.lit(1))
            else:
                same = have[f.name] == f.dataType
                problem = F.lit(None if same else f"type {have[f.name].simpleString()}").cast("string")
                failed = F.lit(0).cast("long") if same else F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull())
            rows.append(F.struct(F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"), problem.alias("problem"), failed.alias("n_failed")))
        found = df.agg(F.array(*rows).alias("_r")).select(F.inline("_r")).where(F.col("problem").isNotNull() | (F.col("n_failed") > 0))
        out = out.unionByName(found)
    return out


# ------------------------------------------------------------------------------------- records
def validate_funds(df: DataFrame, *, name: str = "fund_name", aum: str = "aum", fees: Sequence[str] = ("management_fee", "performance_fee"), launch: str = "launch_date") -> DataFrame:
    """Typed fund records: trimmed name (default Unnamed Fund), AUM in millions, fees as fractions of 0..1, launch date; with reject reasons."""
    out = df.withColumn("_name", F.trim(F.coalesce(F.col(name), F.lit(""))))
    reasons = [F.when(F.col("_name") == "", "missing fund name")]
    typed = {aum: F.when(F.col(aum).cast("string").rlike("[0-9]"), parse_aum_millions(F.col(aum)))}
    for fee in fees:
        x = parse_fraction(F.col(fee))
        typed[fee] = F.when(x.between(0, 1), x)
        reasons.append(F.when(F.col(fee).isNotNull() & ~F.coalesce(x.between(0, 1), F.lit(False)), F.lit(f"invalid {fee}")))
    reasons.append(F.when(F.col(aum).isNotNull() & ~F.col(aum).cast("string").rlike("[0-9]"), "invalid aum"))
    when = parse_date_any(F.col(launch))
    reasons.append(F.when(F.col(launch).isNotNull() & when.isNull(), "invalid launch date"))
    typed[launch] = when
    typed[name] = F.when(F.col("_name") == "", "Unnamed Fund").otherwise(F.col("_name"))
    out = out.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumns(typed)
    return out.drop("_name")


def validate_wallets(df: DataFrame, *, address: str = "address", balance: str = "balance", kind: str = "wallet_type") -> DataFrame:
    """Wallet records with reject reasons: address format; negative balances become null."""
    ok = F.coalesce(is_eth_address(address), F.lit(False))
    return df.withColumn("reasons", F.array_compact(F.array(F.when(~ok, "invalid address")))).withColumns({
        balance: F.when(F.col(balance) >= 0, F.col(balance)), kind: F.coalesce(F.col(kind), F.lit("Unknown"))})


def validate_risks(df: DataFrame, *, factor: str = "factor", rating: str = "rating") -> DataFrame:
    """Risk rows with a rating on 0..10 (0..100 is divided by ten, text becomes 5) and reject reasons."""
    x = F.col(rating).try_cast("double")
    scaled = F.when(x.isNull(), 5.0).when(x.between(0, 10), x).when(x.between(0, 100), x / 10).otherwise(clamp(x, 0, 10))
    missing = F.coalesce(F.trim(F.col(factor)), F.lit("")) == ""
    return df.withColumn("reasons", F.array_compact(F.array(F.when(missing, "missing factor")))).withColumn(rating, scaled)


def validate_team(df: DataFrame, *, name: str = "name") -> DataFrame:
    """Team rows with reject reasons."""
    missing = F.coalesce(F.trim(F.col(name)), F.lit("")) == ""
    return df.withColumn("reasons", F.array_compact(F.array(F.when(missing, "missing name"))))


def validate_compliance(df: DataFrame, columns: Sequence[str] = ("kyc_aml", "regulatory_status", "tax_considerations")) -> DataFrame:
    """Statement lists without blanks; missing lists become empty."""
    none = F.array().cast("array<string>")
    return df.withColumns({c: F.filter(F.coalesce(F.col(c), none), lambda x: F.trim(x) != "") for c in columns}).withColumn("reasons", none)


def validate_market(df: DataFrame, *, price: str = "price", numeric: Sequence[str] = ("market_cap", "volume_24h", "price_change_24h")) -> DataFrame:
    """Market rows with a non-negative price; other fields are numbers or null."""
    p = F.col(price).try_cast("double")
    typed = {c: F.col(c).try_cast("double") for c in numeric if c in df.columns}
    reasons = F.array_compact(F.array(F.when(p.isNull(), "price is not a number"), F.when(p < 0, "negative price")))
    return df.withColumn("reasons", reasons).withColumn(price, p).withColumns(typed)


VALIDATORS = {"fund": validate_funds, "wallet": validate_wallets, "risk": validate_risks, "team": validate_team, "compliance": validate_compliance, "market": validate_market}


def validate(df: DataFrame, entity: str, **columns) -> DataFrame:
    """Coerced records with a ``reasons`` array; empty means valid."""
    return VALIDATORS[entity](df, **columns)


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records (without reasons) and rejected ones."""
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def result_warnings(df: DataFrame, *, name: str = "fund_name", aum: str = "aum", wallets: str = "n_wallets", confidence: str = "confidence", high_factors: str | None = None,
                    issues: str | None = None) -> DataFrame:
    """Missing key fields, validity and warnings of an analysis result row."""
    missing = F.array_compact(F.array(F.when(F.coalesce(F.col(name), F.lit("")) == "", "Fund Name"), F.when(~F.coalesce(F.col(aum) > 0, F.lit(False)), "AUM"),
                                      F.when(~F.coalesce(F.col(wallets) > 0, F.lit(False)), "Wallet Data")))
    notes = [F.when(F.col(confidence) < 70, F.concat(F.lit("Low analysis confidence: "), F.col(confidence), F.lit("%"))),
             F.when(F.col(wallets) == 1, "Single wallet concentration risk")]
    if high_factors:
        notes.append(F.when(F.size(high_factors) > 0, F.concat(F.lit("High risk factors: "), F.array_join(high_factors, ", "))))
    if issues:
        notes.append(F.when(F.col(issues) > 0, F.concat(F.lit("Regulatory issues: "), F.col(issues))))
    out = df.withColumn("missing_fields", missing).withColumn("warnings", F.array_compact(F.array(*notes)))
    return out.withColumn("is_valid", F.size("missing_fields") == 0)


def recommendations(counts: DataFrame, minimum: Mapping[str, tuple[int, str]]) -> DataFrame:
    """What to collect more of: tables below their minimum count."""
    text, low = F.when(F.lit(False), ""), F.when(F.lit(False), 0)
    for name, (limit, advice) in minimum.items():
        text = text.when(F.col("table_name") == name, advice)
        low = low.when(F.col("table_name") == name, limit)
    return counts.withColumn("minimum", low).withColumn("recommendation", text).where(F.col("n") < F.col("minimum"))
