"""Sliding calibration: for each key the newest scores within an age, and their quantile, as a batch and as a stream.

The stream keeps a key's window in list state (`transformWithState`), so its size is bounded by the window, and a timer at the
age of the oldest score lets it shrink when nothing comes. After every batch it has what the batch form gives over all rows
so far, whatever the order within a batch and across restarts: the newest rows of all are among the newest of those before
and those that came.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.ranks import numbered, quantiles

NEWEST, DAYS = 1000, 30
DAY_US = 86_400_000_000
EMPTY = 0.5  # the quantile where there is no score


def sliding_calibration(rows: DataFrame, score: str, ts: str, ident: str, delta: float, *by: str, newest: int = NEWEST, days: int = DAYS) -> DataFrame:
    """(by, n, quantile) over each group's newest rows that are no older than `days` at the group's last time. Of rows of
    one time the larger ids are the newer; rows without score or time are left out."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    given = rows.filter(F.col(score).isNotNull() & F.col(ts).isNotNull()).select(*by, us.alias("__us"), F.col(ident).alias("__id"), F.col(score).alias("__score"))
    last = given.groupBy(*by).agg(F.max("__us").alias("__last")).withColumnsRenamed({b: f"__k{k}" for k, b in enumerate(by)})
    same: Column = F.lit(True)
    for k, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"__k{k}"))
    young = given.join(last, same).filter(F.col("__last") - F.col("__us") <= days * DAY_US).select(*given.columns)
    kept = numbered(young, ["__us", "__id"], *by, rank="__r", n="__n").filter(F.col("__n") - F.col("__r") <= newest)
    sizes = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumnsRenamed({b: f"__k{k}" for k, b in enumerate(by)})
    return quantiles(kept, "__score", {"quantile": 1 - delta}, *by).join(sizes, same).select(*by, "n", "quantile")


class Window(StatefulProcessor):
    """Keeps a key's newest (us, id, score) and gives their quantile after each batch and when some have aged out."""

    def __init__(self, delta: float, newest: int, days: int):
        self.delta, self.newest, self.age = delta, newest, days * DAY_US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "us bigint, id bigint, score double")

    def _keep(self, key: tuple, rows: list[tuple], now: int) -> pd.DataFrame:
        rows = sorted(r for r in rows if now - r[0] <= self.age)[-self.newest :]
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if rows:
            self.rows.put(rows)
            self.handle.registerTimer((rows[0][0] + self.age) // 1000 + 1)
        else:
            self.rows.clear()
        scores = pd.Series([r[2] for r in rows], dtype=float)
        return pd.DataFrame({"key": [key[0]], "n": [len(rows)], "quantile": [float(scores.quantile(1 - self.delta)) if rows else EMPTY]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        for frame in rows:
            held += list(frame[["us", "id", "score"]].itertuples(index=False, name=None))
        if held:
            yield self._keep(key, held, max(r[0] for r in held))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        yield self._keep(key, held, expiredTimerInfo.getExpiryTimeInMs() * 1000)

    def close(self) -> None:
        pass


def stateful_calibration(rows: DataFrame, key: str, score: str, ts: str, ident: str, delta: float, newest: int = NEWEST, days: int = DAYS, late: str = "30 days") -> DataFrame:
    """(key, n, quantile) of every key that a batch or its own age has changed; rows later than `late` are left out.

    Needs the RocksDB state store: `spark.sql.streaming.stateStore.providerClass` (`with_state_store`).
    """
    given = rows.filter(F.col(score).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    shaped = given.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts)).alias("us"), F.col(ident).cast("bigint").alias("id"), F.col(score).cast("double").alias("score"), F.col(ts).alias("ts"))
    out = StructType.fromDDL("key string, n bigint, quantile double")
    return shaped.groupBy("key").transformWithStateInPandas(Window(delta, newest, days), outputStructType=out, outputMode="Update", timeMode="EventTime")


def with_state_store(spark) -> None:
    """Have the session's next streams keep their state in RocksDB, which list state and timers ask for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
