"""Paging and single comments of a thread, the whole briefing, why with a place, labels."""

import json
from datetime import UTC, datetime

import pytest

from threadloom.engine import Engine
from threadloom.operators import codelens
from threadloom.schemas import RAW


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    at = lambda n: f"2024-01-{n:02d}T00:00:00Z"
    ann, bob, bot = ({"login": n, "id": 1, "type": t} for n, t in (("ann", "User"), ("bob", "User"), ("codecov", "Bot")))
    rows = []

    def put(kind, ident, of, **body):
        rows.append(("o/r", kind, str(ident), of, json.dumps(body), datetime(2024, 3, 1), datetime(2024, 3, 1)))

    def pull(number, title, **more):
        put("pr", number, number, number=number, title=title, body=f"Fixes #{90 + number % 2}", state="closed", user=ann, author_association="MEMBER", labels=[{"name": "bug"}, {"name": "core"}], created_at=at(number), updated_at=at(number), pull_request={"merged_at": at(number + 1)}, **more)

    pull(1, "Mask tokens in the cache")
    pull(2, "Cache tokens without a mask")
    pull(4, "Unrelated words")
    put("pr_details", 1, 1, number=1, mergedAt=at(2), commits={"totalCount": 1, "nodes": [{"commit": {"oid": "c" * 40, "messageHeadline": "mask"}}]})
    for n in range(14):
        put("issue_comment", 100 + n, None, id=100 + n, body=f"remark number {n}", user=bob, author_association="NONE", created_at=at(5 + n), updated_at=at(5 + n), issue_url="x/issues/1")
    put("issue_comment", 200, None, id=200, body="coverage", user=bot, author_association="NONE", created_at=at(9), updated_at=at(9), issue_url="x/issues/1")
    for i, (line, path) in enumerate([(10, "src/a.py"), (50, "src/a.py"), (3, "src/b.py")]):
        put("review_comment", 300 + i, None, id=300 + i, body=f"review of line {line}", user=bob, author_association="MEMBER", created_at=at(6), updated_at=at(6), pull_request_url="x/pulls/1", path=path, line=line)
    raw = spark.createDataFrame(rows, RAW)
    return Engine.over(spark, raw, spark.createDataFrame([], "repo string, login string, permission string")).saved(str(tmp_path_factory.mktemp("e")))


def test_a_thread_by_pages_and_single_comments(engine):
    page = engine.thread("o/r", 1, comment=103)
    assert [r.label for r in page["labels"].collect()] == ["bug", "core"] and [(r.target_number, r.resolved) for r in page["links"].collect()] == [(91, False)]
    assert [(r.status, r.body) for r in page["comment"].collect()] == [("served", "remark number 3")]
    status = lambda ident: engine.thread("o/r", 1, comment=ident)["comment"].first()["status"]
    assert status(200) == "suppressed" and status(999) == "absent"
    nxt = engine.thread("o/r", 1, after=(datetime(2024, 1, 15, tzinfo=UTC), "issue_comment", 110))["comments"]
    assert [r.source_id for r in nxt.collect()] == [111, 112, 113]


def test_the_briefing_is_whole(engine):
    found = engine.brief("o/r", 1)
    assert [(r.author, r.issues, r.prs, r.merged) for r in found["opener"].collect()] == [("ann", 0, 3, 3)]
    assert "bob" in str(found["people"].collect())
    assert [r.number for r in found["similar"].collect()] == [2]


def test_why_with_a_place_brings_the_review(engine):
    blamed = lambda path, line: engine.spark.createDataFrame([("o/r", "c" * 40, "mask", path, line)], "repo string, sha string, summary string, path string, line int")
    said = lambda path, line: sorted((r.number, r.level, r.source_id) for r in engine.why(blamed(path, line)).collect())
    assert said("src/a.py", 12) == [(1, 0, 300)] and said("src/b.py", 90) == [(1, 1, 302)] and said("src/c.py", 1) == [(1, 2, 300), (1, 2, 301), (1, 2, 302)]


def test_labels(engine, tmp_path):
    asked = engine.spark.createDataFrame([(["label"], "relevant"), ([], "relevant")], "scopes array<string>, verdict string")
    assert [r.refused for r in engine.label(asked, f"{tmp_path}/l").collect()] == [None, "this token may not label"]


def test_a_symbol(spark):
    defs = spark.createDataFrame([("b.py", "K.run", "run", 3), ("a.py", "run", "run", 9), ("a.py", "J.run", "run", 1)], "path string, qualname string, name string, start int")
    assert [tuple(r) for r in codelens.symbol(defs, "run").collect()] == [("a.py", "run", "run", 9, 3)]
    assert codelens.symbol(defs, "K.run").first()["total"] == 1 and codelens.symbol(defs, "none").count() == 0
