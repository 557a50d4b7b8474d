"""Streaming twins of the batch operators. Every stateful operator takes a watermark delay."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidemark.operators.scoring import alerts
from tidemark.operators.series import INTERVALS, bursts
from tidemark.session import scratch_dir

#: Slots of a key's time in which bursts are searched, in lengths of a burst: more of them mean fewer events in two slots, but larger ones.
BURST_SLOT = 4


def ingest_stream(spark: SparkSession, path: str, schema: StructType, *, fmt: str = "parquet", files_per_trigger: int | None = None,
                  options: Mapping[str, str] | None = None) -> DataFrame:
    """New files of a folder as a stream with a declared schema."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    return reader.load(path)


def dedupe_stream(df: DataFrame, id_col: str, ts: str, delay: str = "1 day") -> DataFrame:
    """First row per id; an id is remembered until the watermark passes its time plus ``delay``."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])


def bars_stream(df: DataFrame, key: str, ts: str, price: str, interval: str = "15m", delay: str = "1 hour", *, tie: str | None = None) -> DataFrame:
    """Open, high, low, close and tick count per key and tumbling window; ``tie`` orders ticks of equal time."""
    place = F.struct(ts, tie) if tie else F.col(ts)
    window = F.window(ts, INTERVALS.get(interval, interval))
    bars = df.withWatermark(ts, delay).groupBy(window.alias("w"), key).agg(
        F.min_by(price, place).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, place).alias("close"), F.count(F.lit(1)).alias("ticks"))
    return bars.select(key, F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "ticks")


def sliding_sentiment(df: DataFrame, ts: str, score: str, *, size: str = "7 days", slide: str = "1 day", delay: str = "1 day", by: str | None = None) -> DataFrame:
    """Mean, count and label counts over sliding windows."""
    keys = [by] if by else []
    out = df.withWatermark(ts, delay).groupBy(F.window(ts, size, slide).alias("w"), *keys).agg(
        F.avg(score).alias("mean"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(score) > 0.6).alias("positive"), F.count_if(F.col(score) < 0.4).alias("negative"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "mean", "n", "positive", "negative")


def latest_stream(df: DataFrame, key: str, ts: str, columns: list[str]) -> DataFrame:
    """Newest row per key, kept up to date; of equal times the row with the largest ``columns``, in their order."""
    return df.groupBy(key).agg(F.max(F.struct(ts, *columns)).alias("_l")).select(key, f"_l.{ts}", *[f"_l.{c}" for c in columns])


def burst_stream(df: DataFrame, key: str, ts: str, k: int = 5, seconds: int = 3600, *, delay: str = "1 hour") -> DataFrame:
    """Rows that start ``k`` events of a key inside less than ``seconds``, wherever they lie: (key, burst_start, span_seconds), as :func:`tidemark.operators.series.bursts`.

    Events become final, in the order of their times, once the watermark has passed them; until then a late event may still come between. A key's time is cut into slots of
    :data:`BURST_SLOT` times ``seconds``, and a slot also gets the first ``seconds`` of the next one, where bursts that start in it can end. The state of a
    slot is its last ``k - 1`` final times and the times the watermark has not passed; a key with most rows, or a first batch that holds years, is never in one task's memory.
    A burst comes out once, when its last event is final; events later than ``delay`` are dropped. The state of a slot that is quiet for ``seconds`` behind the watermark is forgotten. A table that is no
    stream is searched by the batch operator.
    """
    if not df.isStreaming:
        return bursts(df, key, ts, k, seconds)
    kind = df.schema[key].dataType.simpleString()
    limit = seconds * 1_000_000
    width = max(limit, 1) * BURST_SLOT

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = (np.frombuffer(times, np.int64) for times in (state.get if state.exists else (b"", b"")))
        if not state.hasTimedOut:
            waiting = np.concatenate([waiting, *[frame["_us"].to_numpy() for frame in frames]])
        mark = state.getCurrentWatermarkMs() * 1000
        times = np.concatenate([last, np.sort(waiting[waiting <= mark])])
        waiting = waiting[waiting > mark]
        first, spans = times[: max(0, len(times) - k + 1)], times[k - 1 :] - times[: max(0, len(times) - k + 1)]
        found = (spans < limit) & (first // width == group[1])
        # What can still start a burst: not older than `seconds` before the watermark, up to which all is final.
        last = times[max(0, len(times) - k + 1) :] if k > 1 else times[:0]
        last = last[last > mark - limit]
        if len(last) or len(waiting):
            state.update((last.tobytes(), waiting.tobytes()))
            state.setTimeoutTimestamp(max(-(-int(waiting.min()) // 1000) if len(waiting) else (int(last[-1]) + limit) // 1000 + 1, mark // 1000 + 1))
        elif state.exists:
            state.remove()
        if found.any():
            yield pd.DataFrame({"key": [group[0]] * int(found.sum()), "us": first[found], "span": spans[found] / 1e6})

    times = df.where(F.col(ts).isNotNull()).withWatermark(ts, delay).select(F.col(key).alias("_key"), ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
    # Rounded down, also before 1970, as // does; the slot before sees the times that a burst of its own can reach.
    slot, ahead = F.expr(f"(_us - pmod(_us, {width}L)) div {width}L"), F.pmod("_us", F.lit(width)) < limit
    times = times.withColumn("_slot", F.explode(F.array_compact(F.array(slot, F.when(ahead, slot - 1)))))
    found = times.groupBy("_key", "_slot").applyInPandasWithState(step, f"key {kind}, us long, span double", "last binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("key").alias(key), F.timestamp_micros("us").alias("burst_start"), F.col("span").alias("span_seconds"))


def sessions(df: DataFrame, key: str, ts: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of a key: start, end and number of rows; a pause longer than ``gap`` ends one."""
    source = df.withWatermark(ts, delay) if df.isStreaming else df
    out = source.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def start_batches(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, *, mode: str = "append"):
    """Process everything that is there in micro-batches, then stop; restarts continue after the last finished batch."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(work).start()


def alert_sink(df: DataFrame, path: str, checkpoint: str, **options):
    """New alert rows of every batch as Parquet, each alert once. A batch that runs again overwrites its own folder with the same rows.

    Alerts that have been written are keyed state of the stream (a hash partition each reads and writes its own keys only), so a batch costs what its
    own alerts cost, however many have been written before; no batch reads what an earlier one has written.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return start_batches(alerts(df, **options), write, checkpoint)


def divert_late(df: DataFrame, ts: str, delay: str, on_time: str, late: str, checkpoint: str):
    """Split rows that are older than the newest time of *earlier* batches minus ``delay``.

    The newest time per batch is a one-row Parquet table beside the output, so a restart finds it.
    """
    marks = f"{on_time}-marks"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        seen = spark.read.schema("batch_id long, newest timestamp").parquet(marks).where(F.col("batch_id") < batch_id) if batch_id else None
        limit: Column = F.lit(None).cast("timestamp") if seen is None else seen.agg(F.max("newest")).scalar() - F.expr(f"INTERVAL {delay}")
        is_late = F.coalesce(F.col(ts).cast("timestamp") < limit, F.lit(False))
        batch.where(~is_late).write.mode("overwrite").parquet(f"{on_time}/batch_id={batch_id}")
        batch.where(is_late).write.mode("overwrite").parquet(f"{late}/batch_id={batch_id}")
        newest = batch.agg(F.lit(batch_id).cast("long").alias("batch_id"), F.max(F.col(ts).cast("timestamp")).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{marks}/part={batch_id}")
        batch.unpersist()

    return start_batches(df, write, checkpoint)


def run_once(df: DataFrame, label: str, *, mode: str = "complete", folder: str | None = None) -> DataFrame:
    """Run a streaming query over all available input and read back its final result; state and rows go to ``folder`` (a new scratch folder by default).

    ``complete`` keeps the last full result; ``append`` keeps the rows of every batch.
    """
    spark = df.sparkSession
    out = folder or scratch_dir(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        target = f"{out}/result" if mode == "complete" else f"{out}/result/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    start_batches(df, write, f"{out}/state", mode=mode).awaitTermination()
    got = spark.read.parquet(f"{out}/result")
    return got.drop("batch_id") if mode == "append" else got
