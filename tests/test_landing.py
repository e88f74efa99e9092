"""Batches into stored relations: as a rebuild would have it, and only touched buckets are written."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from threadloom.plans.landing import Landing
from threadloom.sources.bucketed import Bucketed

from .test_history import raw_rows

SCHEMA = "repo string, object_type string, object_id string, thread_number long, payload string"


def files_of(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def batch(spark, rows, when):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(when).cast("timestamp") for c in ("fetched_at", "updated_at")})


@pytest.fixture(scope="module")
def authority(spark):
    return spark.createDataFrame([("org/r", "ann", "write")], "repo string, login string, permission string")


def test_buckets_that_a_batch_does_not_touch_stay(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("r"), F.col("id") % 2).alias("repo"), F.col("id").alias("number"), F.lit("old").alias("body"))
    t = Bucketed(spark, f"{tmp_path}/t", rows.schema, buckets=16)
    assert t.read().count() == 0
    t.replace(rows, rows)
    assert sorted(r.number for r in t.read().collect()) == list(range(200))
    before = files_of(tmp_path / "t")
    keys = rows.where("number in (3, 4, 5)")
    t.replace(rows.where("number in (3, 5)").withColumn("body", F.lit("new")), keys)
    touched = {f"bucket={b}/" for b in t.touched(keys)}
    after = files_of(tmp_path / "t")
    assert {f for f in before if after.get(f) != before[f]} == {f for f in before if any(b in f for b in touched)}
    got = {r.number: r.body for r in t.read().collect()}
    assert got == {n: "new" if n in (3, 5) else "old" for n in range(200) if n != 4}
    assert [r.number for r in t.of(keys).orderBy("number").collect()] == [3, 5]
    plan = t.of(keys)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan


def test_a_bucket_can_lose_its_last_row(spark, tmp_path):
    rows = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b")], "repo string, number long, body string")
    t = Bucketed(spark, f"{tmp_path}/t", rows.schema, buckets=64)
    t.replace(rows, rows)
    t.replace(rows.limit(0), rows.where("number = 1"))
    assert [r.number for r in t.read().collect()] == [2] and t.of(rows.where("number = 1")).count() == 0
    t.replace(rows.where("number = 1"), rows.where("number = 1"))
    assert sorted(r.number for r in t.read().collect()) == [1, 2]


def test_batches_equal_one_batch_and_follow_their_threads(spark, tmp_path, authority):
    rows = raw_rows()
    one = [r for r in rows if '"number": 1,' in r[4] or "issues/1" in r[4]]
    rest = [r for r in rows if r not in one]
    land, whole = Landing(spark, f"{tmp_path}/a", 16), Landing(spark, f"{tmp_path}/b", 16)
    assert land.apply(batch(spark, one, "2025-02-01"), authority) == {"insert": 4}
    before = files_of(tmp_path / "a" / "documents")
    land.apply(batch(spark, rest, "2025-02-02"), authority)
    kept = {f for f, m in files_of(tmp_path / "a" / "documents").items() if before.get(f) == m}
    assert kept == set(before)  # thread 1 is in a bucket of its own and was not written again
    whole.apply(batch(spark, rows, "2025-02-02"), authority)
    shown = lambda land, name, *c: sorted(map(str, land.read(name).select(*c).collect()))
    for name, columns in (("documents", ("number", "source_type", "source_id", "body_text", "trust")), ("threads", ("number", "title", "merged_at")), ("files", ("number", "path", "source")), ("links", ("number", "target_number")), ("raw", ("object_type", "object_id", "number"))):
        assert shown(land, name, *columns) == shown(whole, name, *columns)


def test_edits_and_deletions_go_into_the_history(spark, tmp_path, authority):
    rows = [r for r in raw_rows() if '"number": 1,' in r[4] or "issues/1" in r[4]]
    land = Landing(spark, f"{tmp_path}/a", 8)
    land.apply(batch(spark, rows, "2025-02-01"), authority)
    files = files_of(tmp_path / "a" / "history")
    assert land.apply(batch(spark, rows, "2025-02-01"), authority) == {"unchanged": 4} and not land.read("history").count()
    changed = [(*r[:4], r[4].replace("KeyError", "TypeError")) if r[1] == "issue" else r for r in rows if r[2] != "101"]
    assert land.apply(batch(spark, changed, "2025-02-03"), authority) == {"unchanged": 2, "update": 1, "delete": 1}
    history = land.read("history")
    assert sorted((r.source_id, r.reason, str(r.superseded_at)) for r in history.collect()) == [(1, "edited", "2025-02-03 00:00:00"), (101, "deleted", "2025-02-03 00:00:00")]
    assert files.items() <= files_of(tmp_path / "a" / "history").items()
    assert str(land.read("marks").first().high_water) == "2025-02-03 00:00:00"
