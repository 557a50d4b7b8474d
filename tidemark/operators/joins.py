"""Joins that analysis needs beyond the plain equi-join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.functions import texts
from tidemark.functions.symbols import norm_symbol


def join_daily(a: DataFrame, b: DataFrame, ts_a: str, ts_b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Inner join on the calendar day (and optional keys)."""
    left = a.withColumn("day", F.to_date(ts_a))
    right = b.withColumn("day", F.to_date(ts_b))
    left = left if ts_a == "day" else left.drop(ts_a)
    right = right if ts_b == "day" else right.drop(ts_b)
    return left.join(right, ["day", *keys])


def join_with_neutral(prices: DataFrame, sentiment: DataFrame, on: Sequence[str], defaults: Mapping[str, Any]) -> DataFrame:
    """Left join; prices without sentiment get neutral values."""
    return prices.join(sentiment, list(on), "left").fillna(dict(defaults))


def asof_join(left: DataFrame, right: DataFrame, on: str, values: Sequence[str], *, by: str | Sequence[str] | None = None,
              tolerance_seconds: int | None = None, grain: str | None = None, order: str | None = None) -> DataFrame:
    """Every left row with the latest right row at or before it.

    Both sides are interleaved in time inside ``(key, bucket)``, ranges of times of about equally
    many rows (or calendar units, with ``grain``); a bucket takes over what earlier buckets left
    behind, so one hot key, or a table without keys, spreads over its buckets. ``order`` names a column that decides between right rows of equal time.
    """
    names = scale.as_keys(by)
    lefts = [c for c in left.columns if c not in names and c != on]
    payload = F.struct(F.col(on).alias("_at"), *[F.col(v).alias(v) for v in values])
    rank = F.col(order) if order else F.lit(0)
    a = left.select(*names, on, F.struct(*lefts).alias("_left") if lefts else F.struct(F.lit(1).alias("_x")).alias("_left"),
                    F.lit(None).cast("long").alias("_tie"), F.lit(1).alias("_side"))
    b = right.select(*names, on, payload.alias("_right"), rank.cast("long").alias("_tie"), F.lit(0).alias("_side"))
    if not names:
        a, b = a.withColumn("_all", F.lit(1)), b.withColumn("_all", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True)
    filled = scale.carry_forward(both, names or ["_all"], on, {"_match": "_right"},
                                 tie=[F.col("_side"), F.col("_tie")], grain=grain)
    got = F.col("_match")
    if tolerance_seconds is not None:
        near = (F.col(on).cast("double") - F.col("_match._at").cast("double")) <= tolerance_seconds
        got = F.when(near, F.col("_match"))
    rows = filled.where(F.col("_side") == 1).withColumn("_m", got)
    return rows.select(*names, on, *[F.col(f"_left.{c}") for c in lefts], F.col("_m._at").alias(f"{on}_right"),
                       *[F.col(f"_m.{v}").alias(v) for v in values])


def interval_agg_join(points: DataFrame, events: DataFrame, *, lo: str, hi: str, ts: str, aggs: Mapping[str, Column],
                      keys: Sequence[str] = (), grain: str = "day") -> DataFrame:
    """Any aggregates of the events inside each point's ``[lo, hi]`` interval (counts, sums and
    means are cheaper with :func:`interval_stats`, which never pairs points and events).

    Both sides are cut into calendar buckets, so it is an equi-join on the bucket
    with the exact bounds checked afterwards. Points without events keep null aggregates.
    """
    step = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "minute": "INTERVAL 1 MINUTE"}[grain]
    spread = points.distinct().withColumn("_bucket", F.explode(F.sequence(
        scale.calendar_bucket(F.col(lo).cast("timestamp"), grain), scale.calendar_bucket(F.col(hi).cast("timestamp"), grain),
        F.expr(step))))
    bucketed = events.withColumn("_bucket", scale.calendar_bucket(F.col(ts).cast("timestamp"), grain))
    hits = spread.join(bucketed, ["_bucket", *keys]).where((F.col(ts) >= F.col(lo)) & (F.col(ts) <= F.col(hi)))
    totals = hits.groupBy(*[F.col(c).alias(f"_k_{c}") for c in points.columns]).agg(*[c.alias(n) for n, c in aggs.items()])
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in points.columns]
    return points.join(totals, same, "left").select(*points.columns, *aggs)


def interval_stats(points: DataFrame, events: DataFrame, *, lo: str, hi: str, ts: str, value: str, keys: Sequence[str] = (), grain: str | None = None) -> DataFrame:
    """Count, sum and mean of the events inside each point's ``[lo, hi]`` without pairing points and events.

    Interval edges and events are interleaved in time; running totals inside a
    bucket of about equally many rows plus the totals of earlier buckets give each edge its prefix, and the two
    edges are subtracted. Sums are kept as decimals, so the difference is exact.
    """
    zero = F.lit(0).cast("decimal(38,9)")
    columns = points.columns
    row = F.struct(*columns)
    bounded = points.where(F.col(lo) <= F.col(hi)).distinct()
    by = list(keys) or ["_all"]

    def keyed(df: DataFrame) -> DataFrame:
        return df if keys else df.withColumn("_all", F.lit(1))

    def edge(column: str, order: int) -> DataFrame:
        return keyed(bounded.select(*keys, F.col(column).alias("_t"), F.lit(order).alias("_o"), row.alias("_p"), F.lit(0).cast("long").alias("_n"), zero.alias("_v")))

    hits = keyed(events.where(F.col(value).isNotNull()).select(*keys, F.col(ts).alias("_t"), F.lit(1).alias("_o"), F.lit(1).cast("long").alias("_n"), F.col(value).cast("decimal(38,9)").alias("_v")))
    marks = edge(lo, 0).unionByName(edge(hi, 2)).unionByName(hits, allowMissingColumns=True)
    marks = scale.time_bucket(marks, "_t", grain)
    inside = Window.partitionBy(*by, "_bucket").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = marks.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_bn"), F.sum("_v").alias("_bv"))
    totals = totals.select(*by, "_bucket", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_cn"), F.coalesce(F.sum("_bv").over(before), zero).alias("_cv"))
    run = marks.withColumn("_rn", F.sum("_n").over(inside)).withColumn("_rv", F.sum("_v").over(inside)).where(F.col("_o") != 1)
    ends = scale.null_safe_join(run, totals, [*by, "_bucket"]).select("_p", "_o", (F.col("_rn") + F.col("_cn")).alias("_n"), (F.col("_rv") + F.col("_cv")).alias("_v"))

    def at(order: int, column: str) -> Column:
        return F.max(F.when(F.col("_o") == order, F.col(column)))

    sums = ends.groupBy("_p").agg((at(2, "_n") - at(0, "_n")).alias("_dn"), (at(2, "_v") - at(0, "_v")).cast("double").alias("_s"))
    # Points keep their rows, whatever their bounds; an open or reversed interval holds nothing.
    asked = points.select("*", row.alias("_q"))
    same = F.col("_q").eqNullSafe(F.col("_p"))
    good = (F.col(lo) <= F.col(hi)) & (F.col("_dn") > 0)
    out = asked.join(sums, same, "left")
    n = F.when(good, F.col("_dn")).otherwise(F.lit(0)).cast("long")
    return out.select(*columns, n.alias("n"), F.when(good, F.col("_s")).alias("total"), F.when(good, F.col("_s") / F.col("_dn")).alias("mean"))


def side_by_side(df: DataFrame, key: str, on: str, value: str, keys: Sequence[Any]) -> DataFrame:
    """One row per time with one column ``k0``, ``k1`` ... per named key."""
    return df.where(F.col(key).isin(list(keys))).groupBy(on).agg(
        *[F.max(F.when(F.col(key) == k, F.col(value))).alias(f"k{i}") for i, k in enumerate(keys)])


def pair_join(df: DataFrame, key: str, on: str, value: str, keys: Sequence[Any]) -> DataFrame:
    """Every pair of the named keys at each time both have, in the order of the list.

    The keys are lined up in one row per time first, so no self-join is needed and
    a time only ever yields the pairs of the named portfolio.
    """
    wide = side_by_side(df, key, on, value, keys)
    pairs = [F.when(F.col(f"k{i}").isNotNull() & F.col(f"k{j}").isNotNull(), F.struct(
        F.lit(keys[i]).alias("key_a"), F.lit(keys[j]).alias("key_b"),
        F.col(f"k{i}").alias("value_a"), F.col(f"k{j}").alias("value_b")))
        for i in range(len(keys)) for j in range(i + 1, len(keys))]
    return wide.select(on, F.explode(F.array_compact(F.array(*pairs))).alias("_p")).select(on, "_p.*")


def common_keys(df: DataFrame, key: str, on: str) -> DataFrame:
    """Rows at times that every key has."""
    total = df.agg(F.count_distinct(key)).scalar()
    shared = df.groupBy(on).agg(F.count_distinct(key).alias("_n")).where(F.col("_n") == total).select(on)
    return df.join(shared, on, "left_semi")


def enrich_portfolio(holdings: DataFrame, market: DataFrame, sentiment: DataFrame, *, aum: Column,
                     asset: str = "asset", allocation: str = "allocation", symbol: str = "symbol",
                     minimum: float = 0.001) -> DataFrame:
    """Holdings with the latest market row, sentiment and position value; dust positions are dropped."""
    key = norm_symbol(F.col(asset), "base").alias("_base")
    m = market.withColumn("_base", norm_symbol(F.col(symbol), "base")).drop(symbol)
    s = sentiment.withColumn("_base", norm_symbol(F.col(symbol), "base")).drop(symbol)
    kept = holdings.where(F.col(allocation) >= minimum).select("*", key)
    return (kept.join(m, "_base", "left").join(s, "_base", "left")
            .withColumn("position_value", aum * F.col(allocation)).drop("_base"))


def _grams(low: Column, sizes: Sequence[int]) -> Column:
    """Distinct substrings of the given sizes."""
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(low) - (n - 1), F.lit(1)))
        return F.when(F.length(low) >= n, F.transform(starts, lambda i: F.substring(low, i, n))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def substring_join(a: DataFrame, b: DataFrame, a_col: str, b_col: str, *, q: int = 3) -> DataFrame:
    """Each left row with its best right row: equal base symbol first, else the smallest symbol containing the name.

    An inverted index lists the symbols under their substrings of up to ``q`` characters, a few rows for each character. A symbol that contains a name has all
    substrings of the name, so each name only looks up its rarest one and compares itself with the symbols listed there; names of up to ``q``
    characters are looked up whole.
    """
    low = F.lower(F.col(b_col))
    symbols = b.select(b_col).distinct().where(F.length(b_col) > 0)
    index = symbols.select(b_col, low.alias("_low"), F.lower(norm_symbol(F.col(b_col), "base")).alias("_base"), F.explode(_grams(low, range(1, q + 1))).alias("_gram"))
    sizes = index.groupBy("_gram").agg(F.count(F.lit(1)).alias("_listed"))
    names = a.select(a_col).distinct().withColumn("_name", F.lower(F.col(a_col)))
    parts = F.when(F.length("_name") > q, _grams(F.col("_name"), [q])).when(F.length("_name") > 0, F.array("_name"))
    asked = names.select(a_col, "_name", F.explode(parts).alias("_gram")).join(sizes, "_gram", "left")
    rarest = asked.groupBy(a_col, "_name").agg(F.min(F.struct(F.coalesce("_listed", F.lit(0)).alias("_listed"), "_gram")).alias("_rare")).select(a_col, "_name", F.col("_rare._gram").alias("_gram"))
    hits = rarest.join(index, "_gram").where(F.contains("_low", "_name")).withColumn("_rank", F.when(F.col("_base") == F.col("_name"), 0).otherwise(1))
    best = hits.groupBy(a_col).agg(F.min(F.struct("_rank", b_col)).alias("_best")).select(a_col, F.col(f"_best.{b_col}").alias(b_col))
    return a.join(best, a_col, "left")


def lexicon_join(docs: DataFrame, lexicon: Mapping[str, Sequence[str]], *, doc: str, text: str, match: str = "substring") -> DataFrame:
    """(document, category, term, hits) for every lexicon term that occurs. Long lexicons are walked by one automaton per text, whatever their length."""
    body = texts.prepared(F.col("_t"), match)
    listed = [(cat, term) for cat, terms in lexicon.items() for term in terms]
    if len(listed) > texts.EXPRESSION_TERMS:
        names = docs.sparkSession.createDataFrame([(i, cat, term) for i, (cat, term) in enumerate(listed)], "at int, category string, term string")
        hits = docs.select(F.col(doc).alias("_doc"), texts.prepared(text, match).alias("_b")).select("_doc", texts.dictionary_counts(F.col("_b"), [t for _, t in listed], match).alias("_h"))
        found = scale.unnest(hits, ["_doc"], F.col("_h"), "_e").select("_doc", "_e.at", "_e.n")
        return found.join(names, "at").select(F.col("_doc").alias(doc), "category", "term", "n")
    entries = [F.struct(F.lit(cat).alias("category"), F.lit(term).alias("term"), texts.term_count(F.col("_b"), term, match).alias("n"))
               for cat, terms in lexicon.items() for term in terms]
    rows = docs.select(doc, F.col(text).alias("_t")).select(doc, body.alias("_b")).select(doc, F.explode(F.array(*entries)).alias("_e"))
    return rows.select(doc, "_e.category", "_e.term", "_e.n").where(F.col("n") > 0)


def term_equi_join(docs: DataFrame, terms: DataFrame, *, doc: str, text: str, term: str = "term") -> DataFrame:
    """Single-word dictionary of any size joined to document words: (document, term columns, hits)."""
    words = scale.unnest(docs, [doc], texts.words(F.col(text)), "_w").groupBy(doc, "_w").agg(F.count(F.lit(1)).alias("n"))
    return words.join(terms.withColumn("_w", F.lower(F.col(term))), "_w").drop("_w")


def mentions(docs: DataFrame, entities: Sequence[str], *, doc: str, text: str) -> DataFrame:
    """(document, entity, start, end) of every occurrence, ignoring case."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    names = F.array(*[F.struct(F.lit(n).alias("entity"), F.lit(len(n)).alias("size"), F.transform(F.split(F.col("_t"), F.lit("\\Q" + n.lower() + "\\E"), -1), F.length).alias("gaps")) for n in entities])
    out = docs.select(doc, low.alias("_t"), F.monotonically_increasing_id().alias("_row")).select(doc, "_row", F.explode(names).alias("_m"))
    out = out.where(F.size("_m.gaps") > 1)
    gaps = out.select(doc, "_row", "_m.entity", "_m.size", F.posexplode(F.slice(F.col("_m.gaps"), F.lit(1), F.size("_m.gaps") - 1)).alias("_i", "_gap"))
    # Start of occurrence i = lengths of the pieces before it plus i earlier names.
    before = Window.partitionBy("_row", "entity").orderBy("_i")
    start = (F.sum("_gap").over(before) + F.col("_i") * F.col("size")).cast("int")
    return gaps.select(doc, "entity", start.alias("start"), (start + F.col("size")).alias("end"))


def proximity_join(found: DataFrame, *, doc: str, window: int = 150) -> DataFrame:
    """Directed counts of entities that start or end within ``window`` characters of another, per document.

    Instead of pairing all mentions of a document, a mention only meets those in
    its own and the neighbouring position cells.
    """
    cell = F.floor(F.col("start") / F.lit(2 * window)).cast("long")
    src = found.select(doc, F.col("entity").alias("src"), F.col("start").alias("s0"), F.col("end").alias("s1"), cell.alias("_cell"))
    dst = found.select(doc, F.col("entity").alias("dst"), F.col("start").alias("d0"), F.col("end").alias("d1"),
                       F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    lo, hi = F.greatest(F.col("s0") - window, F.lit(0)), F.col("s1") + window
    near = ((F.col("d0") >= lo) & (F.col("d0") <= hi)) | ((F.col("d1") >= lo) & (F.col("d1") <= hi))
    return (src.join(dst, [doc, "_cell"]).where((F.col("src") != F.col("dst")) & near)
            .groupBy(doc, "src", "dst").agg(F.count(F.lit(1)).alias("weight")))


def missing_from(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the other table lacks."""
    return df.join(other, list(keys), "left_anti")


def having_recent(df: DataFrame, key: str, ts: str, *, days: int, k: int, as_of: Column) -> DataFrame:
    """Rows of keys with at least ``k`` rows in the last ``days`` days."""
    recent = df.where(F.col(ts) >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
    active = recent.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).select(key)
    return df.join(active, key, "left_semi")


def full_features(a: DataFrame, b: DataFrame, keys: Sequence[str], fill: float = 0.0) -> DataFrame:
    """One row per key with the features of both sides; what is absent becomes ``fill``."""
    return a.join(b, list(keys), "full_outer").fillna(fill)
