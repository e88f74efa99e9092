"""A pinned engine can't tell what came later."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from threadloom.engine import Engine
from threadloom.operators import asof
from threadloom.schemas import RAW

T = datetime(2021, 6, 1, tzinfo=UTC)


def user(login):
    return {"login": login, "id": 1, "type": "User"}


def payload(kind, ident, number, body):
    at = datetime(2022, 1, 1)
    return ("o/r", kind, str(ident), number, json.dumps(body), at, at)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    early, late = "2021-01-01T00:00:00Z", "2021-09-01T00:00:00Z"

    def head(number, created, **more):
        return {"number": number, "title": f"Thread {number}", "body": "See `get_mask` in src/cache.py", "state": "closed", "user": user("ann"), "author_association": "MEMBER", "created_at": created, "updated_at": late, **more}

    rows = [
        payload("pr", 1, 1, head(1, early, pull_request={"merged_at": late}, merged_at=late, closed_at=late)),
        payload("pr_details", 1, 1, {"number": 1, "mergedAt": late, "files": {"totalCount": 1, "nodes": [{"path": "src/secret_later.py", "changeType": "MODIFIED"}]}, "commits": {"totalCount": 1, "nodes": [{"commit": {"oid": "a" * 40, "messageHeadline": "later (#1)"}}]}}),
        payload("pr", 2, 2, head(2, early, pull_request={"merged_at": early}, merged_at=early, closed_at=early)),
        payload("pr_details", 2, 2, {"number": 2, "mergedAt": early, "files": {"totalCount": 1, "nodes": [{"path": "src/merged_early.py", "changeType": "ADDED"}]}, "commits": {"totalCount": 1, "nodes": [{"commit": {"oid": "b" * 40, "messageHeadline": "early (#2)"}}]}}),
        payload("issue", 3, 3, head(3, late)),
        payload("issue_comment", 11, 1, {"id": 11, "body": "ValueError: edited words here `late_symbol()`", "user": user("bob"), "author_association": "MEMBER", "created_at": early, "issue_url": "x/issues/1"}),
        payload("issue_comment", 12, 1, {"id": 12, "body": "later reply with tests/test_late.py", "user": user("cat"), "author_association": "NONE", "created_at": late, "issue_url": "x/issues/1"}),
    ]
    raw = spark.createDataFrame(rows, RAW)
    made = Engine.over(spark, raw, spark.createDataFrame([], "repo string, login string, permission string")).saved(str(tmp_path_factory.mktemp("engine")))
    was = made.corpus.documents.where("source_id = 11").withColumns({"body_markdown": F.lit("KeyError: first words `early_symbol()`"), "body_text": F.lit("KeyError: first words early_symbol"), "superseded_at": F.lit(datetime(2021, 8, 1, tzinfo=UTC))})
    gone = was.withColumns({"source_id": F.lit(13).cast("long"), "body_markdown": F.lit("deleted remark on src/gone.py"), "body_text": F.lit("deleted remark on src/gone.py"), "doc_key": F.lit("o/r:1:issue_comment:13:0")})
    from dataclasses import replace

    return replace(made, history=was.unionByName(gone).cache())


def test_texts_are_the_versions_that_stood(engine):
    then = {r["source_id"]: r["body_text"] for r in engine.pinned(T).corpus.documents.where("source_type = 'issue_comment'").collect()}
    assert then == {11: "KeyError: first words early_symbol", 13: "deleted remark on src/gone.py"}
    after = engine.pinned(datetime(2021, 8, 15, tzinfo=UTC)).corpus.documents.where("source_type = 'issue_comment'")
    assert [(r["source_id"], "edited" in r["body_text"]) for r in after.collect()] == [(11, True)]


def test_signals_are_read_again(engine):
    c = engine.pinned(T).corpus
    got = lambda df, column: sorted({r[column] for r in df.where("number = 1").collect()})
    assert got(c.symbols, "symbol") == ["early_symbol", "get_mask"] and got(c.errors, "message_norm") == ["first words `early_symbol()`"]
    assert got(c.files, "path") == ["src/cache.py", "src/gone.py"]
    assert sorted(r["path"] for r in c.files.where("number = 2").collect()) == ["src/cache.py", "src/merged_early.py"]


def test_verbs_take_the_pin(engine):
    then = engine.pinned(T)
    assert engine.search("edited words")[0].count() == 1 and then.search("edited words", match="all")[0].where("body_text like '%edited%'").count() == 0
    assert [r["source_id"] for r in then.search("KeyError first")[0].collect()][:1] == [11]
    head = then.thread("o/r", 1)["head"].first()
    assert head["state"] == "open" and head["merged_at"] is None
    assert then.thread("o/r", 3)["head"].count() == 0 and engine.thread("o/r", 3)["head"].count() == 1
    blamed = engine.spark.createDataFrame([("o/r", "a" * 40, "later"), ("o/r", "b" * 40, "early")], "repo string, sha string, summary string")
    assert {r["number"] for r in engine.why(blamed).collect()} == {1, 2} and {r["number"] for r in then.why(blamed).collect()} == {2}
    assert then.status().first()["threads"] == 2


def test_pins_narrow_and_never_loosen(engine):
    then = engine.pinned(T, exclude=(2,))
    assert then.pinned(datetime(2030, 1, 1, tzinfo=UTC)).pin == then.pin
    again = then.pinned(exclude=(1,))
    assert again.pin.before == T and set(again.pin.exclude) == {1, 2} and again.corpus.threads.count() == 0
    assert engine.pinned(exclude=(1,)).corpus.documents.where("number = 1").count() == 0
    with pytest.raises(ValueError):
        engine.pinned(datetime(2021, 1, 1))


def test_versions_of_one_text(spark):
    at = lambda n: datetime(2021, 1, n, tzinfo=UTC)
    now = spark.createDataFrame([(1, "c", at(1)), (2, "only", at(5)), (3, "undated", None)], "k long, body string, created_at timestamp")
    old = spark.createDataFrame([(1, "a", at(1), at(10)), (1, "b", at(1), at(20)), (4, "gone", at(2), at(3))], "k long, body string, created_at timestamp, superseded_at timestamp")
    rows = asof.versions(now, old, ["k"]).cache()
    stood = lambda n: sorted(r["body"] for r in rows.where(asof.stood_at(F.lit(at(n)))).collect())
    assert stood(1) == [] and stood(2) == ["a"] and stood(3) == ["a", "gone"] and stood(10) == ["a", "only"] and stood(11) == ["b", "only"] and stood(25) == ["c", "only"]
    assert asof.versions(now, None, ["k"]).where(asof.stood_at(F.lit(at(30)))).count() == 2
