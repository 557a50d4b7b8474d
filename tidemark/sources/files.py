"""File scans: price CSVs with any header, article JSON, text corpora and raw pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import scale
from tidemark.functions.dates import DATE_FORMATS, epoch_auto, try_parse
from tidemark.functions.numbers import parse_number
from tidemark.functions.symbols import NAME_TO_TICKER

# Exchanges that file names mention.
EXCHANGES = ["Binance", "Coinbase", "Kraken", "Bitfinex", "Bitstamp", "CoinW", "CME", "Huobi", "OKX", "KuCoin", "Gemini", "Bybit", "Gate", "Poloniex", "Bittrex"]


def local_path(uri: Column) -> Column:
    """File location with its URI escapes undone."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def header_roles(names: Sequence[str]) -> dict[str, int]:
    """Column position of date, open, high, low, close and volume by name fragment."""
    roles: dict[str, int] = {}
    fragments = [("date", ("date", "time")), ("open", ("open",)), ("high", ("high",)), ("low", ("low",)), ("close", ("close", "price")), ("volume", ("vol",))]
    for i, name in enumerate(names):
        low = name.lower()
        for role, parts in fragments:
            if any(p in low for p in parts):
                roles.setdefault(role, i)
                break
    return roles


def detect_date_format(df: DataFrame, column: str, by: str) -> DataFrame:
    """(by, format, n_rejected): the notation that most values of the file fit, the first listed on a tie; ``unix`` / ``unix_ms`` for epoch numbers.

    Values that do not fit the winner are counted as rejected; a file no value of which fits any notation has a null format.
    """
    text = F.trim(F.regexp_replace(F.col(column), "[\"']", ""))
    tests = {f: try_parse(text, f).isNotNull() for f in DATE_FORMATS}
    number = F.when(text.rlike("^[0-9]+$"), text.try_cast("long"))
    tests["unix"] = F.coalesce((number > 1000000000) & (number < 9999999999), F.lit(False))
    tests["unix_ms"] = F.coalesce((number > 1000000000000) & (number < 9999999999999), F.lit(False))
    votes = df.where(text != "").groupBy(by).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(f"_f{i}") for i, c in enumerate(tests.values())])
    best = F.array_max(F.array(*[F.struct(F.col(f"_f{i}").alias("hits"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, name in enumerate(tests)]))
    won = votes.withColumn("_best", best)
    return won.select(by, F.when(F.col("_best.hits") > 0, F.col("_best.name")).alias("date_format"), (F.col("_n") - F.col("_best.hits")).alias("n_rejected"))


def parse_detected(text: Column, fmt: Column) -> Column:
    """Timestamp of a text in its detected notation; null (not a made-up date) when it does not fit."""
    clean = F.trim(F.regexp_replace(text, "[\"']", ""))
    out = F.when(fmt.isin("unix", "unix_ms"), epoch_auto(clean))
    for f in DATE_FORMATS:
        out = out.when(fmt == f, try_parse(clean, f))
    return out


def read_ohlcv_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Price CSVs with any header: roles by name, detected dates, missing open/high/low = close, missing volume = 0.

    Every file is read by the roles of its own header line. Rows without a
    positive close, high and low are dropped.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line"), local_path(F.col("_metadata.file_path")).alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("place"))
    low = F.lower("line")
    is_header = (low.contains("date") | low.contains("time")) & (low.contains("open") | low.contains("close") | low.contains("price"))
    # The first such line of a file; comments are no headers.
    headers = lines.where(is_header & ~F.col("line").startswith("#")).groupBy("file").agg(F.min_by("line", "place").alias("header"))
    # One row per distinct header line: bounded by the number of export formats, not by files or rows.
    layouts = {}
    for row in headers.select("header").distinct().collect():
        names = [n.strip().strip('"') for n in row["header"].split(",")]
        roles = header_roles(names)
        if "date" in roles and "close" in roles:
            layouts[row["header"]] = (len(names), roles)
    if not layouts:
        raise ValueError("no price CSV header found")
    width = max(n for n, _ in layouts.values())
    cells = F.from_csv("line", ", ".join(f"c{i} string" for i in range(width)))
    parsed = lines.join(headers, "file").where(F.col("line") != F.col("header")).select("file", "header", cells.alias("_c"))

    def role(name: str) -> Column:
        out = F.when(F.lit(False), "")
        for header, (_, roles) in layouts.items():
            if name in roles:
                out = out.when(F.col("header") == header, F.col(f"_c.c{roles[name]}"))
        return out

    # Comment lines have no number in the close column.
    out = parsed.select("file", role("date").alias("date_text"), *[role(n).alias(n) for n in ("open", "high", "low", "close", "volume")])
    out = out.where(F.col("date_text").isNotNull() & F.col("close").rlike("[0-9]"))
    formats = detect_date_format(out, "date_text", "file")
    close = parse_number("close")
    typed = out.join(formats, "file", "left").select(
        "file", parse_detected(F.col("date_text"), F.col("date_format")).alias("timestamp"),
        *[F.when(F.col(c).rlike("[0-9]"), parse_number(c)).otherwise(close).alias(c) for c in ("open", "high", "low")], close.alias("close"), parse_number("volume").alias("volume"))
    return typed.where((F.col("close") > 0) & (F.col("high") > 0) & (F.col("low") > 0))


def file_name(column: str | Column = "file") -> Column:
    return F.regexp_extract(F.col(column) if isinstance(column, str) else column, r"([^/]+)$", 1)


def with_symbol(df: DataFrame, column: str = "file", quote: str = "USD") -> DataFrame:
    """Symbol from ``BASE_QUOTE rest.csv``, ``BASEQUOTE rest.csv`` or an asset name in the file name."""
    name = F.upper(file_name(column))
    pair = F.regexp_extract(name, r"^([A-Z0-9]{2,10})[_-](USDT|USDC|USD|BTC|ETH|EUR)\b", 0)
    joined = F.regexp_extract(name, r"^([A-Z0-9]{2,10}(?:USDT|USDC|USD))\b", 1)
    named = F.when(F.lit(False), "")
    for asset, ticker in NAME_TO_TICKER.items():
        named = named.when(name.contains(asset), F.lit(ticker + quote))
    first = F.regexp_extract(name, r"^([A-Z0-9]+)", 1)
    symbol = F.when(pair != "", F.regexp_replace(pair, "[_-]", "")).when(joined != "", joined).otherwise(F.coalesce(named, first))
    return df.withColumn("symbol", symbol)


def with_exchange(df: DataFrame, column: str = "file", exchanges: Sequence[str] = tuple(EXCHANGES)) -> DataFrame:
    """First known exchange the path mentions, else ``Unknown Exchange``."""
    low = F.lower(column)
    out = F.when(F.lit(False), "")
    for name in exchanges:
        out = out.when(low.contains(name.lower()), name)
    return df.withColumn("exchange", out.otherwise("Unknown Exchange"))


ARTICLE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("title", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("content", T.StringType()), T.StructField("date", T.StringType()), T.StructField("authors", T.ArrayType(T.StringType())),
    T.StructField("image_url", T.StringType()), T.StructField("scraped_at", T.StringType())])


def read_articles(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One article per JSON file (or per line, with ``multi_line=False``); the date may be epoch milliseconds or text."""
    df = spark.read.schema(ARTICLE).json(path, multiLine=multi_line)
    when = F.coalesce(F.when(F.col("date").rlike("^[0-9]+$"), epoch_auto("date")), F.try_to_timestamp("date"))
    return df.withColumn("date", when).withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file with its name, size and modification time."""
    df = spark.read.text(path, wholetext=True)
    return df.select(file_name(local_path(F.col("_metadata.file_path"))).alias("file_name"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("file_size"),
                     F.col("_metadata.file_modification_time").alias("modified"))


# HTML entities turned back into characters; ampersand last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def unescape(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_to_text(df: DataFrame, html: str) -> DataFrame:
    """Title and visible text of raw pages: article body if there is one, without scripts, styles, navigation and tags."""
    page = F.col(html)
    title = F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)
    body = F.regexp_extract(page, r"(?is)<article[^>]*>(.*?)</article>", 1)
    body = F.when(body != "", body).otherwise(page)
    for block in ("script", "style", "nav", "header", "footer", "title"):
        body = F.regexp_replace(body, rf"(?is)<{block}\b[^>]*>.*?</{block}>", " ")
    body = F.regexp_replace(body, r"(?s)<!--.*?-->", " ")
    body = F.regexp_replace(body, r"(?s)<[^>]*>", " ")
    return df.withColumn("title", F.trim(F.regexp_replace(unescape(title), r"\s+", " "))).withColumn("text", F.trim(F.regexp_replace(unescape(body), r"\s+", " ")))


# ------------------------------------------------------------------------------- nested payloads
def flatten(df: DataFrame, sep: str = "_", max_depth: int = 10, positions: int = 3) -> DataFrame:
    """Nested structs to flat columns; arrays of structs get ``positions`` numbered columns and, for the elements beyond them, a JSON column
    ``<name>_rest`` (null if there are none); other arrays become text."""
    columns: list[Column] = []

    def walk(col: Column, kind: T.DataType, name: str, depth: int) -> None:
        if isinstance(kind, T.StructType) and depth < max_depth:
            for f in kind.fields:
                walk(col[f.name], f.dataType, f"{name}{sep}{f.name}" if name else f.name, depth + 1)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and depth < max_depth:
            for i in range(positions):
                walk(F.get(col, F.lit(i)), kind.elementType, f"{name}{sep}{i}", depth + 1)
            columns.append(F.when(F.size(col) > positions, F.to_json(F.slice(col, positions + 1, F.size(col)))).alias(f"{name}{sep}rest"))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            columns.append(F.to_json(col).alias(name))
        else:
            columns.append(col.alias(name))

    for f in df.schema.fields:
        walk(F.col(f"`{f.name}`"), f.dataType, f.name, 0)
    return df.select(*columns)


def candles_to_ohlcv(df: DataFrame, array: str, keep: Sequence[str] = ()) -> DataFrame:
    """[open_ms, open, high, low, close, volume, ...] arrays to typed rows; rows that do not parse are skipped."""
    def at(i: int) -> Column:
        return F.get(F.col(array), F.lit(i))

    out = df.select(*keep, F.timestamp_millis(at(0).try_cast("long")).alias("timestamp"),
                    *[at(i).try_cast("double").alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), start=1)])
    return out.dropna(subset=["timestamp", "open", "high", "low", "close", "volume"])


def first_available(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of the first source, and of the second those keys the first lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def normalize_ticker(df: DataFrame, *, source_col: str = "source", source: str | None = None, ticker: str = "ticker", price: str = "price",
                     fields: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, reject counts): upper-case symbol, numeric fields, price above zero."""
    rows = df if source is None else df.where(F.col(source_col) == source)
    p = F.col(price).try_cast("double")
    ok = F.coalesce(p > 0, F.lit(False)) & (F.trim(F.coalesce(F.col(ticker), F.lit(""))) != "")
    typed = rows.where(ok).select(F.upper(F.trim(ticker)).alias("symbol"), p.alias("price"),
                                  *[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(n) for n, c in (fields or {}).items()])
    counts = rows.agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))
    return typed, counts


def splice(hist: DataFrame, recent: DataFrame, key: str, ts: str, last: int | None = None) -> DataFrame:
    """History before each key's first recent row, then all recent rows; optionally the last ``last`` per key."""
    starts = recent.groupBy(key).agg(F.min(ts).alias("_from"))
    old = hist.join(starts, key, "left").where(F.col("_from").isNull() | (F.col(ts) < F.col("_from"))).drop("_from")
    both = old.unionByName(recent, allowMissingColumns=True)
    return both if last is None else scale.top_per_key(both, key, [F.col(ts).desc()], last)
