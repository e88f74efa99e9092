"""Evaluation sets: invariants, additions, freezing."""

import pytest
from pyspark.sql import functions as F

from threadloom.operators import datasets


def examples(spark, rows):
    shaped = [(i, k, q, f, [], None, [], [("o/r", n, "") for n in r] if r is not None else None, j, "") for i, k, q, f, r, j in rows]
    return spark.createDataFrame(shaped, datasets.EXAMPLE)


GOOD = [("a", "failure", "cache mask", [], [1], "human"), ("b", "precedent", "", ["x.py"], [], None), ("c", "rationale", None, ["y.py"], [2, 3], "model")]


def test_faults(spark):
    assert datasets.faults(examples(spark, GOOD)).count() == 0
    bad = [("d", "other", "x", [], [1], None), ("e", None, "x", [], [1], "me"), ("f", "failure", " ", [], None, "human"), ("g", "failure", "x", [], [1], None), ("g", "failure", "y", [], [1], None), (None, "failure", "x", [], [1], None)]
    got = sorted((r.id or "", r.fault) for r in datasets.faults(examples(spark, GOOD + bad)).collect())
    assert got == [("", "no id"), ("d", "unknown slice"), ("e", "unknown judge"), ("e", "unknown slice"), ("f", "asks nothing"), ("f", "judged without a relevant thread"), ("g", "duplicate id")]


def test_a_frozen_set_stays(spark, tmp_path):
    path, good = str(tmp_path / "set"), examples(spark, GOOD)
    stored = datasets.Dataset(spark, path)
    assert stored.header() is None
    stored.save(good)
    more = datasets.added(stored.examples(), examples(spark, [("a", "failure", "changed", [], [1], None), ("z", "failure", "new", [], [1], None)]))
    assert {r.id: r["query"] for r in more.collect()} == {"a": "cache mask", "b": "", "c": None, "z": "new"}
    more = spark.createDataFrame(more.collect(), datasets.EXAMPLE)
    stored.save(more, freeze=True)
    assert stored.header()["frozen_at"]
    stored.save(more)  # the same rows are no change
    for changed in (good, more.withColumn("note", F.lit("x"))):
        with pytest.raises(ValueError, match="frozen"):
            stored.save(changed)
    with pytest.raises(ValueError, match="unknown slice"):
        datasets.Dataset(spark, str(tmp_path / "other")).save(examples(spark, [("d", "other", "x", [], [1], None)]))
    assert sorted(r.id for r in datasets.judged(stored.examples()).collect()) == ["a", "c"]


def test_floors_of_windows(spark):
    windows = spark.createDataFrame([("a", "2020"), ("a", "2019"), ("b", "2020"), ("b", None)], "repo string, since string")
    assert {r.repo: r.since for r in datasets.oldest_floor(windows).collect()} == {"a": "2019", "b": None}


def test_labels_that_may_not_be_stored(spark, tmp_path):
    rows = [(["label"], "relevant", "q"), (["read"], "relevant", "q"), (None, "relevant", "q"), (["label"], "maybe", "q"), (["label"], None, "q")]
    asked = spark.createDataFrame(rows, "scopes array<string>, verdict string, query string")
    got = datasets.append_labels(asked, f"{tmp_path}/labels")
    assert [r.refused for r in got.collect()] == [None, "this token may not label", "this token may not label", "unknown verdict", "unknown verdict"]
    assert spark.read.json(f"{tmp_path}/labels").count() == 1
