"""Building blocks that stay balanced when one key owns a large share of the rows.

Spark combines algebraic aggregates on the map side, so a plain ``groupBy`` is
safe for a hot key. Ordered work is not: a window puts a whole key in one task.
The helpers below split a key by a *deterministic* bucket (a range of times that holds
about the same number of rows as any other, or a power-of-two value band), work inside
``(key, bucket)`` and stitch the buckets through a table with one row per key and
bucket. The number of buckets follows the session's shuffle partitions, never the data.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def as_keys(keys: str | Keys | None) -> list[str]:
    """One name, several names or none as a list."""
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


def top_per_key(df: DataFrame, keys: str | Keys | None, order: Sequence[Column], n: int, *,
                rank: str | None = None, salts: int = 64) -> DataFrame:
    """The first ``n`` rows of every key in ``order``.

    A row-number filter lets Spark cut each map partition to ``n`` rows per key
    before the shuffle; for ``n`` > 1 a salted round first caps what a hot key
    sends to its final task at ``salts * n`` rows.
    """
    names = as_keys(keys)
    if not names:
        out = df.orderBy(*order).limit(n)
        if rank is None:
            return out
        return out.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
    if n > 1 and salts > 1:
        salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if _hashable(df, c)]), F.lit(salts))
        salted = df.withColumn("_salt", salt)
        first = Window.partitionBy(*names, "_salt").orderBy(*order)
        df = salted.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= n).drop("_rn", "_salt")
    final = Window.partitionBy(*names).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(final)).where(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


def _hashable(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() not in ("map", "variant")


def calendar_bucket(ts: str | Column, grain: str) -> Column:
    """Start of the calendar unit (``minute``, ``hour``, ``day`` ...) that holds ``ts``."""
    return F.date_trunc(grain, F.col(ts) if isinstance(ts, str) else ts)


#: Buckets of time for each shuffle partition, and sampled rows for each bucket.
BUCKETS_PER_PARTITION, ROWS_PER_BUCKET = 4, 100


def time_bucket(df: DataFrame, ts: str, grain: str | None = None, name: str = "_bucket") -> DataFrame:
    """Add the number of the row's range of times; ranges follow the times and hold about equally many rows of the table each.

    The edges are exact quantiles of a sample that is chosen by a hash of the row, in a scalar subquery of the plan: the same rows give the same edges
    in every branch and every attempt of a task. A day with a third of all rows is cut like any other third; only rows of one time stay
    together. ``grain`` takes calendar units instead, which needs no pass over the data but is only as even as the calendar.
    Rows without a time are in the first range.
    """
    if grain:
        return df.withColumn(name, calendar_bucket(F.col(ts).cast("timestamp"), grain))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    levels = max(5, (BUCKETS_PER_PARTITION * partitions).bit_length())
    edges = (1 << levels) - 1
    moment = F.unix_micros(F.col(ts).cast("timestamp"))
    share = df.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / (ROWS_PER_BUCKET * edges))).cast("long")).scalar()
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if _hashable(df, c)])
    sample = df.where(F.pmod(hashed, share) == 0).select(moment.alias("_us"))
    cuts = sample.agg(F.percentile("_us", F.array(*[F.lit((i + 1) / (edges + 1)) for i in range(edges)]))).scalar()
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(levels))])
    # Halving: the number of edges at or before the row's time.
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.element_at(F.col("_cuts"), at + step) <= F.col("_us"), at + step).otherwise(at))
    return df.withColumns({"_us": moment, "_cuts": cuts}).withColumn(name, place).drop("_us", "_cuts")


def unnest(df: DataFrame, keep: Sequence[str | Column], array: str | Column, name: str, position: str | None = None) -> DataFrame:
    """One row per array element next to the kept columns; empty arrays give none.

    A plain ``explode`` of a computed column makes the optimizer copy the computation
    into a filter below it, so long texts would be tokenized several times.
    """
    if position is None:
        out = df.select(*keep, F.explode_outer(array).alias(name))
        return out.where(F.col(name).isNotNull())
    out = df.select(*keep, F.posexplode_outer(array).alias(position, name))
    return out.where(F.col(position).isNotNull())


def value_band(value: Column, per_octave: int = 64) -> Column:
    """A monotone integer band: ``per_octave`` bands for each doubling of the value.

    The band count is bounded by the exponent range of a double, so a table with
    one row per band fits one task whatever the data size.
    """
    x = value.cast("double")
    size = F.floor(F.log2(F.abs(x) + F.lit(1e-9)) * per_octave) + F.lit(32 * per_octave)
    return (F.signum(x) * size).cast("long")


def exact_percentiles(df: DataFrame, keys: str | Keys | None, value: str,
                      quantiles: Mapping[str, float], *, discrete: bool = False) -> DataFrame:
    """Exact percentiles per key without holding a key's values in one task.

    Equal values collapse to counts first, bands of values give the prefix sums,
    and only the bands that hold a wanted rank are ordered. ``discrete`` picks the
    smallest value whose cumulative share reaches the quantile; otherwise the two
    neighbours are interpolated linearly.
    """
    names = as_keys(keys)
    base = df if names else df.withColumn("_all", F.lit(1))
    by = names or ["_all"]
    counts = (
        base.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_band", value_band(F.col("_v")))
    )
    up_to = Window.partitionBy(*by).orderBy("_band").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    bands = (
        counts.groupBy(*by, "_band").agg(F.sum("_c").alias("_in"))
        .withColumn("_end", F.sum("_in").over(up_to))
        .withColumn("_n", F.sum("_in").over(whole))
        .withColumn("_start", F.col("_end") - F.col("_in"))
    )
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in quantiles.items()])
    asked = bands.select(*by, "_band", "_start", "_end", "_n", F.explode(wanted).alias("_w"))
    if discrete:
        low = F.greatest(F.ceil(F.col("_w.q") * F.col("_n")) - 1, F.lit(0))
        high = low
    else:
        position = F.col("_w.q") * (F.col("_n") - 1)
        low, high = F.floor(position), F.ceil(position)
    asked = (
        asked.withColumn("_lo", low.cast("long")).withColumn("_hi", high.cast("long"))
        .where(((F.col("_lo") >= F.col("_start")) & (F.col("_lo") < F.col("_end")))
               | ((F.col("_hi") >= F.col("_start")) & (F.col("_hi") < F.col("_end"))))
    )
    inside = Window.partitionBy(*by, "_band").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (
        counts.join(bands.select(*by, "_band", "_start"), [*by, "_band"])
        .join(asked.select(*by, "_band").distinct(), [*by, "_band"], "left_semi")
        .withColumn("_last", F.col("_start") + F.sum("_c").over(inside))
        .withColumn("_first", F.col("_last") - F.col("_c"))
        .select(*by, "_band", "_v", "_first", "_last")
    )
    def holds(rank: str) -> Column:
        return (F.col(rank) >= F.col("_first")) & (F.col(rank) < F.col("_last"))

    picked = (
        asked.join(ends, [*by, "_band"])
        .where(holds("_lo") | holds("_hi"))
        .groupBy(*by, F.col("_w.name").alias("_name"), F.col("_w.q").alias("_q"), "_n", "_lo", "_hi")
        .agg(F.max(F.when(holds("_lo"), F.col("_v"))).alias("_a"),
             F.max(F.when(holds("_hi"), F.col("_v"))).alias("_b"))
    )
    if discrete:
        result = F.col("_a")
    else:
        share = F.col("_q") * (F.col("_n") - 1) - F.col("_lo")
        result = F.col("_a") + (F.col("_b") - F.col("_a")) * share
    wide = picked.groupBy(*by).agg(
        *[F.max(F.when(F.col("_name") == name, result)).alias(name) for name in quantiles])
    return wide if names else wide.drop("_all")


def percentiles_of(df: DataFrame, keys: str | Keys | None, columns: Sequence[str], quantiles: Mapping[str, float], *, discrete: bool = False) -> DataFrame:
    """Exact percentiles of several columns in one pass: per key one struct of the quantiles for each column, named like it."""
    names = as_keys(keys)
    values = F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in columns])
    rows = df.select(*names, F.explode(values).alias("_x")).select(*names, "_x._column", "_x._value")
    long = exact_percentiles(rows, [*names, "_column"], "_value", quantiles, discrete=discrete)
    return long.groupBy(*names).agg(*[F.max(F.when(F.col("_column") == c, F.struct(*quantiles))).alias(c) for c in columns])


def carry_forward(df: DataFrame, keys: str | Keys, ts: str, columns: Mapping[str, str], *,
                  tie: Sequence[Column] = (), grain: str | None = None, forward: bool = True) -> DataFrame:
    """Last (or, backwards, next) non-null value of each column up to the row, per key.

    Works inside ``(key, bucket)``, see :func:`time_bucket`; what earlier buckets leave
    behind comes from a table with one row per key and bucket.
    """
    names = as_keys(keys)
    bucketed = time_bucket(df, ts, grain)
    order = [F.col(ts), *tie]
    if not forward:
        order = [F.col(ts).desc(), *[t.desc() for t in tie]]
    inside = Window.partitionBy(*names, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    pick = F.max_by if forward else F.min_by
    place = F.struct(F.col(ts), *tie) if tie else F.col(ts)
    ends = bucketed.groupBy(*names, "_bucket").agg(
        *[pick(F.when(F.col(src).isNotNull(), F.struct(F.col(src).alias("v"))),
               F.when(F.col(src).isNotNull(), place)).alias(f"_end_{out}")
          for out, src in columns.items()])
    before = Window.partitionBy(*names).orderBy(F.col("_bucket") if forward else F.col("_bucket").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    carried = ends.select(*names, "_bucket", *[
        F.last(f"_end_{out}", ignorenulls=True).over(before).alias(f"_carry_{out}") for out in columns])
    local = bucketed.select("*", *[
        F.last(F.when(F.col(src).isNotNull(), F.struct(F.col(src).alias("v"))), ignorenulls=True).over(inside)
        .alias(f"_local_{out}") for out, src in columns.items()])
    joined = null_safe_join(local, carried, [*names, "_bucket"], "left")
    out = joined
    for name in columns:
        out = out.withColumn(name, F.coalesce(F.col(f"_local_{name}"), F.col(f"_carry_{name}"))["v"])
    drop = ["_bucket"] + [f"_local_{n}" for n in columns] + [f"_carry_{n}" for n in columns]
    return out.drop(*drop)


def row_index(df: DataFrame, keys: str | Keys, ts: str, *, tie: Sequence[Column] = (), grain: str | None = None,
              name: str = "row_index", total: str | None = None) -> DataFrame:
    """Zero-based position of every row in its key's time order, for keys of any size."""
    names = as_keys(keys)
    bucketed = time_bucket(df, ts, grain)
    sizes = bucketed.groupBy(*names, "_bucket").agg(F.count(F.lit(1)).alias("_in"))
    up_to = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*names)
    sizes = sizes.select(*names, "_bucket", (F.sum("_in").over(up_to) - F.col("_in")).alias("_before"),
                         F.sum("_in").over(whole).alias("_total"))
    inside = Window.partitionBy(*names, "_bucket").orderBy(F.col(ts), *tie)
    out = (
        null_safe_join(bucketed.withColumn("_rn", F.row_number().over(inside)), sizes, [*names, "_bucket"])
        .withColumn(name, (F.col("_before") + F.col("_rn") - 1).cast("long"))
    )
    if total:
        out = out.withColumn(total, F.col("_total").cast("long"))
    return out.drop("_bucket", "_rn", "_before", "_total")


def over_rows(df: DataFrame, keys: str | Keys, ts: str, exprs: Callable[[Window], Mapping[str, Column]], *,
              back: int, ahead: int = 0, split: int | None = None, grain: str | None = None,
              tie: Sequence[Column] = ()) -> DataFrame:
    """Add window columns whose frames reach at most ``back`` rows back and ``ahead`` rows on.

    ``split=None`` uses one window per key and is meant for series with a calendar
    bound (one row per key and day). With ``split`` a key is cut into blocks of
    that many rows; every block also receives the few neighbour rows its frames
    need, so the result is the same and no task sees more than one block.
    """
    names = as_keys(keys)
    if split is None:
        w = Window.partitionBy(*names).orderBy(F.col(ts), *tie)
        return df.select("*", *[c.alias(n) for n, c in exprs(w).items()])
    size = max(split, back, ahead, 1)
    indexed = row_index(df, names, ts, tie=tie, grain=grain, name="_ix")
    block = F.floor(F.col("_ix") / size).cast("long")
    place = F.col("_ix") % size
    homes = F.array_compact(F.array(
        block,
        F.when(place >= size - back, block + 1) if back else F.lit(None).cast("long"),
        F.when((place < ahead) & (block > 0), block - 1) if ahead else F.lit(None).cast("long")))
    spread = indexed.withColumn("_own", block).withColumn("_block", F.explode(homes))
    w = Window.partitionBy(*names, "_block").orderBy("_ix")
    done = spread.select("*", *[c.alias(n) for n, c in exprs(w).items()])
    return done.where(F.col("_block") == F.col("_own")).drop("_ix", "_own", "_block")


def running_extreme(df: DataFrame, keys: str | Keys, ts: str, value: str, out: str, *,
                    grain: str | None = None, largest: bool = True) -> DataFrame:
    """Running maximum (or minimum) per key in time order, split by bucket of time."""
    names = as_keys(keys)
    agg = F.max if largest else F.min
    pick = F.greatest if largest else F.least
    bucketed = time_bucket(df, ts, grain)
    ends = bucketed.groupBy(*names, "_bucket").agg(agg(value).alias("_m"))
    before = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*names, "_bucket", agg("_m").over(before).alias("_before"))
    inside = Window.partitionBy(*names, "_bucket").orderBy(ts).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        null_safe_join(bucketed.withColumn("_local", agg(value).over(inside)), ends, [*names, "_bucket"])
        .withColumn(out, pick("_local", "_before"))
        .drop("_bucket", "_local", "_before")
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of the same names that also matches null with null."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = None
    for k in keys:
        same = F.col(f"`{k}`").eqNullSafe(F.col(f"`_r_{k}`"))
        on = same if on is None else on & same
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def with_totals(df: DataFrame, keys: str | Keys | None, totals: Mapping[str, Column]) -> DataFrame:
    """Attach aggregates of the whole key (or whole table) without a window; rows without a key form one group.

    The aggregate combines on the map side and joins back; Spark broadcasts it
    when its measured size is small and splits a skewed key otherwise.
    """
    names = as_keys(keys)
    sums = df.groupBy(*names).agg(*[c.alias(n) for n, c in totals.items()]) if names else df.agg(
        *[c.alias(n) for n, c in totals.items()])
    if names:
        return null_safe_join(df, sums, names, "left")
    row = sums.select(F.struct(*totals.keys()).alias("_t")).scalar()
    out = df.withColumn("_t", row)
    for name in totals:
        out = out.withColumn(name, F.col(f"_t.{name}"))
    return out.drop("_t")
