"""Streamed limits equal those of the whole table, with bounded state."""

import numpy as np
from pyspark.sql import functions as F

from threadloom.streaming import ingest, limits


def test_three_micro_batches_equal_the_table(spark, tmp_path):
    draw = np.random.default_rng(6)
    base = 1_700_000_000
    seconds = np.sort(base + draw.choice(3 * 86_400, 400, replace=False))
    rows = [(i, int(draw.integers(0, 4)), float(s)) for i, s in enumerate(seconds)] + [(1000 + i, 9, float(base + 100_000 + i)) for i in range(80)]
    calls = spark.createDataFrame(sorted(rows, key=lambda r: r[2]), "event_id long, user_id long, s double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    cuts = [calls.where("ts < timestamp '2023-11-15 12:00:00'"), calls.where("ts >= timestamp '2023-11-15 12:00:00' and ts < timestamp '2023-11-16 06:00:00'"), calls.where("ts >= timestamp '2023-11-16 06:00:00'")]
    for i, part in enumerate(cuts):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        limits.with_rocksdb(spark)
        stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        run = limits.limited(stream, per_minute=5, per_day=40).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination(120)
        assert not run.isActive and run.exception() is None
        batches = [p for p in run.recentProgress if p["numInputRows"]]
        kept = run.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {r.call: (r.in_rate, r.in_quota) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    rate = {r.event_id: r.allowed for r in ingest.over_rate(calls, per_minute=5).collect()}
    day = {}
    for r in calls.orderBy("ts").collect():
        key = (r.user_id, r.ts.date())
        day[key] = day.get(key, 0) + 1
        assert got[r.event_id] == (rate[r.event_id], day[key] <= 40)
    assert len(got) == 480 and not all(a for a, _ in got.values()) and not all(b for _, b in got.values())
    assert len(batches) == 3 and kept <= 30  # a few values and timers a caller, however many calls it made
