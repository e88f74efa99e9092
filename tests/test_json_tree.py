"""JSON of any shape, against plain recursion; objects as they are served."""

import json
import random

from pyspark.sql import functions as F

from threadloom.functions import json_tree
from threadloom.operators import projections

PARTS = ["plain", 'quo"te', "back\\slash", "\\", "new\nline", "<|im_start|>", "[INST]", "[/INST] <<SYS>>", "zero​width", "é ☃ 𝄞", "\u0007bell", "", "a" * 3000, "{not: [json]}", " "]


def tree(r, depth):
    kind = r.randrange(7 if depth else 4)
    if kind < 2:
        return "".join(r.choices(PARTS, k=r.randrange(3)))
    if kind < 4:
        return r.choice([None, True, False, 0, -12, 10**30, 1.25])
    if kind < 5:
        return [tree(r, depth - 1) for _ in range(r.randrange(4))]
    return {r.choice(("url", "html_url", "x_url", "login", "type", "id", "repository", "k[INST]", "body")): tree(r, depth - 1) for _ in range(r.randrange(6))}


def mapped(v, f):
    if isinstance(v, str):
        return f(v)
    if isinstance(v, list):
        return [mapped(w, f) for w in v]
    return {f(k): mapped(w, f) for k, w in v.items()} if isinstance(v, dict) else v


def stripped(v):
    if isinstance(v, list):
        return [stripped(w) for w in v]
    if not isinstance(v, dict):
        return v
    if {"login", "type"} <= set(v):
        return {k: w for k, w in v.items() if k in json_tree.ACCOUNT}
    return {k: stripped(w) for k, w in v.items() if k == "html_url" or not (k in json_tree.MIRRORS or k.endswith("_url"))}


def test_strings_at_any_depth(spark):
    r = random.Random(5)
    trees = [tree(r, 6) for _ in range(150)]
    texts = [json.dumps(t, ensure_ascii=i % 2 == 0, indent=[None, 1][i % 3 == 0]) for i, t in enumerate(trees)]
    words = sorted({w for t in trees for w in _strings(t)})
    plain = {x.w: x.s for x in spark.createDataFrame([(w,) for w in words], "w string").select("w", json_tree.scrub(F.col("w")).alias("s")).collect()}
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", json_tree.scrub_tree(F.col("t")).alias("t")).collect()
    for row in got:
        assert json.loads(row.t) == mapped(trees[row.i], plain.__getitem__)


def _strings(v):
    if isinstance(v, str):
        yield v
    for w in v if isinstance(v, list) else v.values() if isinstance(v, dict) else ():
        yield from _strings(w)
    if isinstance(v, dict):
        yield from v


def test_what_is_no_json(spark):
    long = json.dumps({"a": "x[INST]" * 200_000})
    deep = "[" * 100_000 + '"[INST]"' + "]" * 100_000
    texts = [None, "", "no json", '"open', '{"a": 1.50, "b": 12345678901234567890123}', r'{"a": "\x"}', '"[INST]" tail "', long, deep]
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", json_tree.scrub_tree(F.col("t")).alias("t")).orderBy("i").collect()]
    assert got[:6] == texts[:6]
    mark = "[SCRUBBED:special-token INST]"
    assert got[6:] == [f'"{mark}" tail "', long.replace("[INST]", mark), deep.replace("[INST]", mark)]


def test_mirrors(spark):
    r = random.Random(6)
    trees = [tree(r, 6) for _ in range(150)]
    rows = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)] + [(200, None), (201, "{"), (202, "[" * 200_000 + "]" * 200_000)], "i int, t string")
    got = {x.i: x.t for x in rows.select("i", json_tree.without_mirrors("t").alias("t")).collect()}
    for i, t in enumerate(trees):
        assert json.loads(got[i]) == stripped(t)
    assert got[200] is None and got[201] == "{" and got[202] == "[" * 200_000 + "]" * 200_000


def test_served_objects(spark):
    now = F.to_timestamp(F.lit("2025-01-11"))
    rows = [('a "b"', 2, True, 1.23456789, {"lexical": 0.1234567}), (None, 0, False, 0.5, {}), ("x", None, None, None, None)]
    hits = spark.createDataFrame(rows, "title string, passages int, truncated boolean, score double, breakdown map<string,double>").withColumns({"created_at": F.to_timestamp(F.lit("2025-01-01")), "source_type": F.lit("review"), "source_id": F.lit(7), "chunk_index": F.lit(0)})
    a, b, c = (json.loads(r[0]) for r in hits.select(projections.hit_json(hits, now)).collect())
    assert a["title"] == 'a "b"' and a["passages"] == 2 and a["truncated"] is True and a["score"] == 1.234568 and a["breakdown"] == {"lexical": 0.123457}
    assert (a["age"], a["date"], a["document_id"]) == ("10d", "2025-01-01T00:00:00Z", "review:7:0")
    assert b["title"] is None and not {"passages", "truncated"} & set(b) and b["score"] == 0.5
    assert tuple(c) == projections.HIT
    assert tuple(json.loads(hits.select(projections.hit_json(hits, now, compact=True)).first()[0])) == (*projections.HIT, "passages", "truncated")
    assert tuple(json.loads(hits.select(projections.outline_json(hits, now)).first()[0])) == projections.OUTLINE


def test_nobody_claims(spark):
    asked = spark.createDataFrame([("r", 1), ("q", 2), ("r", 1)], "repo string, number long")
    none = spark.createDataFrame([], "repo string, target_number long, number long, position int, total long, created_at timestamp, merged_at timestamp")
    links = spark.createDataFrame([("r", 5)], "repo string, number long")
    got = {r.repo: json.loads(r.json) for r in projections.inflight_json(asked, none, links, F.current_timestamp()).collect()}
    assert got == {"r": {"repo": "r", "number": 1, "claims": [], "claims_returned": 0, "claims_total": 0, "links_indexed": 1}, "q": {"repo": "q", "number": 2, "claims": [], "claims_returned": 0, "claims_total": 0, "links_indexed": 0}}
