"""Passes: marks that failures hold, a first fill that is interrupted, samples, and who may write."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from threadloom.plans import passes
from threadloom.plans.landing import Landing

STAGED = "repo string, day int, walk int, ok boolean"


def marks(spark, rows):
    staged = spark.createDataFrame(rows, STAGED).withColumn("updated_at", F.when(F.col("day").isNotNull(), F.expr("timestamp '2025-01-01' + make_interval(0, 0, 0, day)"))).drop("day")
    return {r.repo: (None if r.high_water is None else (r.high_water - datetime(2025, 1, 1)).days, r.held) for r in passes.marks(staged).collect()}


def test_marks(spark):
    walk = [("a", d, 1, True) for d in range(6)] + [("b", 9, 1, True)]
    assert marks(spark, walk) == {"a": (5, 0), "b": (9, 0)}
    assert marks(spark, [(r, d, w, not (r == "a" and d == 3)) for r, d, w, _ in walk]) == {"a": (2, 1), "b": (9, 0)}
    failed = [(r, d, w, d != 3) for r, d, w, _ in walk]
    assert marks(spark, failed + [("a", 2, 2, True)]) == {"a": (2, 1), "b": (9, 0)}  # the later walk ended before it
    assert marks(spark, failed + [("a", 2, 2, True), ("a", 3, 2, True)]) == {"a": (5, 0), "b": (9, 0)}
    assert marks(spark, failed + [("a", 2, 2, True), ("a", 3, 2, False)]) == {"a": (2, 1), "b": (9, 0)}  # it failed again
    assert marks(spark, walk + [(None, 4, 1, False)]) == {"a": (3, 1), "b": (None, 1)}  # whose it was is unknown
    assert marks(spark, walk + [("a", None, 1, False)]) == {"a": (None, 1), "b": (9, 0)}
    assert marks(spark, []) == {}


def land(folder, walk, part, rows):
    at = folder / f"walk={walk}"
    at.mkdir(parents=True, exist_ok=True)
    (at / f"{part}.json").write_text("".join(r if isinstance(r, str) else json.dumps(r) + "\n" for r in rows), encoding="utf-8")


def issue(n, day, body="b"):
    at = f"2025-01-{day:02d}T00:00:00Z"
    payload = {"number": n, "title": f"t{n}", "body": body, "user": {"login": "ann", "type": "User"}, "author_association": "NONE", "created_at": at, "updated_at": at}
    return {"repo": "org/r", "object_type": "issue", "object_id": str(n), "payload": json.dumps(payload), "fetched_at": at, "updated_at": at}


def test_a_run_that_dies_is_started_again(spark, tmp_path, monkeypatch):
    lists = tmp_path / "landed" / "threads"
    land(lists, 1, "a", [issue(n, n) for n in (1, 2, 3, 4)])
    land(lists, 1, "b", [issue(4, 4), issue(5, 5), {**issue(6, 6), "payload": "{"}, issue(7, 7)])  # a slice begins where the one before ended
    land(lists, 1, "c", ["not json\n", issue(8, 8)])
    authority = spark.createDataFrame([("org/r", "ann", "write")], "repo string, login string, permission string")
    fill = passes.Backfill(Landing(spark, f"{tmp_path}/index", 2), f"{tmp_path}/landed", files_per_batch=1)
    whole = passes.Backfill.stage

    def dies(self, batch, name, number):
        if number == 1:
            batch.limit(1).withColumn("ok", F.lit(True)).write.mode("overwrite").parquet(f"{self._path}/{name}/batch={number}")  # a part of it is written
            raise RuntimeError("lost")
        whole(self, batch, name, number)

    monkeypatch.setattr(passes.Backfill, "stage", dies)
    with pytest.raises(Exception, match="lost"):
        fill.walk("threads")
    monkeypatch.setattr(passes.Backfill, "stage", whole)
    fill.walk("threads")
    fill.walk("threads")  # nothing new
    staged = sorted((r.object_id or "", r.ok) for r in fill.staged("threads").collect())
    assert staged == [("", False), ("1", True), ("2", True), ("3", True), ("4", True), ("4", True), ("5", True), ("6", False), ("7", True), ("8", True)]
    mark = fill.marks("threads").where("repo is not null").first()
    assert (mark.high_water, mark.held) == (None, 2)  # a row that nothing is known of holds its walk from the start
    assert fill.index(authority, ["threads"]) == {"insert": 14}
    assert fill.index(authority, ["threads"]) == {}  # the cursor has moved
    land(lists, 2, "a", [issue(n, n, "again" if n == 6 else "b") for n in range(1, 9)])
    assert fill.run(authority, ["threads"]) == {"unchanged": 14, "insert": 2}
    mark = fill.marks("threads").where("repo is not null").first()
    assert (str(mark.high_water), mark.held) == ("2025-01-08 00:00:00", 0)
    assert sorted(r.number for r in fill.landing.read("threads").collect()) == [1, 2, 3, 4, 5, 6, 7, 8]


def test_samples(spark):
    t = lambda d: f"2025-01-{d:02d}"
    asked = [("r", "issue", t(5), False, 2), ("r", "pr", t(5), True, None), ("s", "issue", t(1), False, None)]
    asked = spark.createDataFrame(asked, "repo string, thread_type string, since string, merged_only boolean, most int").withColumn("since", F.to_timestamp("since"))
    times = lambda rows, name: spark.createDataFrame(rows, "repo string, thread_type string, at string").select("repo", "thread_type", F.to_timestamp("at").alias(name))
    windows = passes.sample_windows(asked, times([("r", "issue", t(5)), ("r", "pr", t(9))], "indexed_from"), times([("r", "issue", t(7)), ("r", "pr", t(20))], "high_water"))
    got = {(r.repo, r.thread_type): (r.widens, str(r.walk_from)) for r in windows.collect()}
    assert got == {("r", "issue"): (False, "2025-01-06 23:59:00"), ("r", "pr"): (True, "2025-01-05 00:00:00"), ("s", "issue"): (False, "2025-01-01 00:00:00")}
    rows = [("r", n, "issue", t(n), None) for n in (5, 6, 7, 8, 9)] + [("r", 20, "pr", t(6), t(6)), ("r", 21, "pr", t(7), None), ("s", 5, "issue", t(2), None), ("q", 1, "issue", t(9), None)]
    listing = spark.createDataFrame(rows, "repo string, number long, thread_type string, u string, m string").select("repo", "number", "thread_type", F.to_timestamp("u").alias("updated_at"), F.to_timestamp("m").alias("merged_at"))
    known = listing.where("number in (7, 20)").withColumn("updated_at", F.when(F.col("number") == 7, F.col("updated_at")).otherwise(F.to_timestamp(F.lit(t(1)))))
    got = sorted((r.repo, r.number, r.action) for r in passes.sample(windows, listing, known).collect())
    assert got == [("r", 7, "skip"), ("r", 8, "fetch"), ("r", 20, "fetch"), ("s", 5, "fetch")]
    shown = asked.select(passes.selector(F.col("since"), F.col("merged_only"), F.col("most")).alias("s"))
    assert [r.s for r in shown.collect()] == ["updated>=2025-01-05T00:00:00Z, limit 2", "updated>=2025-01-05T00:00:00Z, merged only", "updated>=2025-01-01T00:00:00Z"]


def test_who_may_write(spark):
    people = spark.createDataFrame([("r", c) for c in "abcdef"] + [("r", "a")], "repo string, login string")
    known = spark.createDataFrame([("r", "a", "write", "2025-03-30"), ("r", "b", "write", "2025-01-01"), ("r", "f", None, "2025-03-30")], "repo string, login string, permission string, at string").withColumn("checked_at", F.to_timestamp("at"))
    answers = spark.createDataFrame([("r", "a", "none"), ("r", "b", "none"), ("r", "c", "admin")], "repo string, login string, permission string")
    merged = spark.createDataFrame([("r", "d"), ("r", "b"), ("q", "e")], "repo string, login string")
    found = passes.resolved_authority(people, answers, merged, known, F.to_timestamp(F.lit("2025-04-01")))
    got = {r.login: (r.permission, r.source, r.changed, r.promoted) for r in found.collect()}
    assert got == {
        "a": ("write", "stored", False, False), "b": ("none", "permission_api", True, False), "c": ("admin", "permission_api", True, True),
        "d": ("write", "merged_by", True, True), "e": (None, "association", False, False), "f": (None, "stored", False, False),
    }
    texts = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b"), ("r", 2, "d"), ("r", 3, None), ("q", 4, "d")], "repo string, number long, author string")
    assert [tuple(r) for r in passes.threads_to_derive(found, texts).collect()] == [("r", 2)]
