"""Incremental ingest: micro-batches, marks that stop at the first failure, rates and quotas."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

OVERLAP_SECONDS = 60
PER_MINUTE, PER_DAY = 60, 5000


def window_start(high_water: Column) -> Column:
    """A pass starts a little before its mark; doing a row twice changes nothing."""
    return high_water - F.expr(f"interval {OVERLAP_SECONDS} seconds")


def candidates(threads: DataFrame, comments: DataFrame, key: Sequence[str]) -> DataFrame:
    """What either list brought up, each key once with its first time."""
    both = threads.select(*key, "ts", F.lit(False).alias("commented")).union(comments.select(*key, "ts", F.lit(True).alias("commented")))
    return both.groupBy(*key).agg(F.min_by("ts", F.struct("commented", "ts")).alias("ts"), F.max("commented").alias("commented"))


def skip_current(found: DataFrame, known: DataFrame, key: Sequence[str]) -> DataFrame:
    """Leave out what is stored with the same time, unless a review comment brought it up."""
    fresh = found.where(~F.col("commented")).join(known.select(*key, "ts"), [*key, "ts"], "left_anti")
    return fresh.unionByName(found.where("commented"))


def committed_mark(results: DataFrame, key: Sequence[str], bound: Column | None = None) -> DataFrame:
    """(key, high_water, held): the last success before the first failure; with a bound, no later than that."""
    first_failure = F.min(F.when(~F.col("ok"), F.col("ts"))).over(Window.partitionBy(*key))
    rows = results.withColumn("_stop", first_failure)
    mark = F.max(F.when(F.col("ok") & (F.col("_stop").isNull() | (F.col("ts") < F.col("_stop"))), F.col("ts")))
    mark = F.least(mark, F.first(bound)) if bound is not None else mark
    return rows.groupBy(*key).agg(mark.alias("high_water"), F.count_if(~F.col("ok")).alias("held"))


def over_rate(calls: DataFrame, who: str = "user_id", ts: str = "ts", per_minute: int = PER_MINUTE) -> DataFrame:
    """Each call with the number of calls in the 60 seconds up to it, and whether it is within the rate."""
    trailing = Window.partitionBy(who).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-60_000_000 + 1, 0)
    return calls.withColumn("in_minute", F.count("*").over(trailing)).withColumn("allowed", F.col("in_minute") <= per_minute)


def daily_quota(calls: DataFrame, who: str = "user_id", ts: str = "ts", per_day: int = PER_DAY) -> DataFrame:
    return calls.groupBy(who, F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("calls")).select(who, F.col("w.start").alias("day"), "calls", (F.col("calls") <= per_day).alias("allowed"))


def deduplicated(stream: DataFrame, key: Sequence[str], ts: str = "ts", late: str = f"{OVERLAP_SECONDS} seconds") -> DataFrame:
    """Each key once, within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(list(key))


def ingest(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], once: bool = False, every: str = "5 minutes") -> StreamingQuery:
    """Run `work` on each micro-batch; it commits what succeeds and keeps failures as rows, so a batch never blocks."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
