"""Structured Streaming forms: ingest with verification and dedup, windows, stateful means, quotas and batch sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of event files; times become instants, which watermarks ask for."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def first_writes(events: DataFrame, key: str = "event_id", horizon: str = "14 days") -> DataFrame:
    """Each key's first row within the horizon; invalid rows are dropped before they can hold a key."""
    valid = events.filter(F.col(key).isNotNull() & F.col("value").isNotNull() & (F.col("value") >= 0))
    return valid.withWatermark("ts", horizon).dropDuplicatesWithinWatermark([key])


def daily_totals(events: DataFrame, late: str = "1 day") -> DataFrame:
    w = F.window("ts", "1 day")
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("day"), "event_type", "n", "total")


def sliding_errors(events: DataFrame, width: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", width, slide)
    out = events.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return out.select(F.col("w.start").alias("start"), "n", "errors")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _expires(frame_ms: int, state: GroupState, idle_ms: int) -> int:
    """When a state seen at frame_ms expires, in event time; never behind the watermark."""
    return max(frame_ms, state.getCurrentWatermarkMs()) + idle_ms


def _last_ms(frame: pd.DataFrame, before: int) -> int:
    return max(before, int(frame["ts"].max().timestamp() * 1000)) if len(frame) else before


def stateful_ewma(events: DataFrame, alpha: float = 0.3, idle_ms: int = 14 * 86_400_000, late: str = "1 day") -> DataFrame:
    """Each user's exponentially weighted mean after every batch; the state of users idle in event time expires, and
    events later than `late` are left out."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, mean = state.get if state.exists else (0, 0.0)
        last = 0
        for frame in frames:
            last = _last_ms(frame, last)
            for v in frame.sort_values(["ts", "event_id"])["value"]:
                mean = float(v) if n == 0 else alpha * float(v) + (1 - alpha) * mean
                n += 1
        state.update((n, mean))
        state.setTimeoutTimestamp(_expires(last, state, idle_ms))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "ewma": [mean]})

    grouped = events.withWatermark("ts", late).groupBy("user_id")
    return grouped.applyInPandasWithState(update, "user_id bigint, n bigint, ewma double", "n bigint, ewma double", "update", GroupStateTimeout.EventTimeTimeout)


def stateful_quota(events: DataFrame, quota: int, idle_ms: int = 2 * 86_400_000, late: str = "1 day") -> DataFrame:
    """Events with admitted: the first quota of a user within 24 hours of the first one, anchored anew after that.
    Events later than `late` are left out."""
    day = 86_400_000_000

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        anchor, used = state.get if state.exists else (None, 0)
        last = 0
        for frame in frames:
            last = _last_ms(frame, last)
            frame = frame.sort_values(["ts", "event_id"])
            out = []
            for t in frame["ts"].astype("int64") // 1000:
                if anchor is None or t - anchor >= day:
                    anchor, used = int(t), 0
                used += 1
                out.append(used <= quota)
            yield pd.DataFrame({"event_id": frame["event_id"], "user_id": frame["user_id"], "admitted": out})
        if anchor is not None:
            state.update((anchor, used))
        state.setTimeoutTimestamp(_expires(last, state, idle_ms))

    grouped = events.withWatermark("ts", late).groupBy("user_id")
    return grouped.applyInPandasWithState(update, "event_id bigint, user_id bigint, admitted boolean", "anchor bigint, used bigint", "append", GroupStateTimeout.EventTimeTimeout)


def routed_sink(accepted: str, rejected: str, good: Column) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink in two places; a replayed batch overwrites its own folders and so writes once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        batch.filter(good).write.mode("overwrite").parquet(f"{accepted}/batch={batch_id}")
        batch.filter(~good).write.mode("overwrite").json(f"{rejected}/batch={batch_id}")
        batch.unpersist()

    return write


def run_once(stream: DataFrame, checkpoint: str, name: str, mode: str = "append", limit_s: float = 3600.0) -> None:
    """Drain what is there into the in-memory table name; a query that has not ended within limit_s is stopped with an error."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not q.awaitTermination(limit_s):
        q.stop()
        raise TimeoutError(f"stream {name} did not drain within {limit_s} s")
