"""Rate and quota of callers as streaming state: bounded for each caller, and dropped when a caller stays away."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threadloom.streaming.ingest import PER_DAY, PER_MINUTE

_MINUTE, _DAY = 60_000_000, 86_400_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Limits(StatefulProcessor):
    """State of a caller: the times of its last per_minute calls, which decide the rate, and the day of its last call with the calls of that day.

    No more than per_minute times are kept, however many calls come: whether a call is within the rate is told by the per_minute-th call
    before it.
    """

    def __init__(self, who: str, per_minute: int, per_day: int):
        self.who, self.per_minute, self.per_day = who, per_minute, per_day

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", "times array<long>")
        self.today = handle.getValueState("today", "day long, calls long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        calls = pd.concat(list(rows), ignore_index=True).sort_values(["us", "call"], kind="stable")
        times = list(self.recent.get()[0]) if self.recent.exists() else []
        day, count = self.today.get() if self.today.exists() else (None, 0)
        within, counted = [], []
        for us in calls["us"].tolist():
            # the call that stands per_minute places back tells: if it is within the minute, this one is too many
            within.append(len(times) < self.per_minute or times[-self.per_minute] <= us - _MINUTE)
            times = (times + [us])[-self.per_minute :]
            if us // _DAY != day:
                day, count = us // _DAY, 0
            count += 1
            counted.append(count)
        self.recent.update((times,))
        self.today.update((day, count))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((day + 1) * 86_400_000)  # a day that is over limits nothing
        yield pd.DataFrame({self.who: [key[0]] * len(calls), "call": calls["call"], "in_rate": within, "of_day": counted, "in_quota": [c <= self.per_day for c in counted]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.recent.clear()
        self.today.clear()
        return iter([])


def limited(calls: DataFrame, call: str = "event_id", who: str = "user_id", ts: str = "ts", per_minute: int = PER_MINUTE, per_day: int = PER_DAY, late: str = "60 seconds") -> DataFrame:
    """Each call of a stream (or table) with in_rate, of_day and in_quota: at most per_minute calls in the 60 seconds up to it, and its number in its day.

    Calls of one micro-batch are taken by time; a call that comes in a later batch counts after those of earlier ones. Null callers are one
    caller; calls without a time are left out. A caller's state is dropped once the watermark passes the end of its last day. The session needs the RocksDB state store (ROCKSDB).
    """
    rows = calls.where(F.col(ts).isNotNull()).select(F.col(who), F.col(call).alias("call"), F.col(ts).cast("timestamp").alias("at")).withColumn("us", F.unix_micros("at")).withWatermark("at", late)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    shape = f"{who} {kinds[who]}, call {kinds['call']}, in_rate boolean, of_day long, in_quota boolean"
    return rows.groupBy(who).transformWithStateInPandas(_Limits(who, per_minute, per_day), shape, "Append", "EventTime")


def with_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark
