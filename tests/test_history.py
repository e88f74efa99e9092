"""The engine over landed payloads, and the small cases that its rules come from."""

import json
from datetime import UTC, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom import schemas
from threadloom.engine import Engine
from threadloom.functions import extract, text
from threadloom.functions.chunking import chunks_of
from threadloom.functions.porter import stem
from threadloom.operators import evaluation, filters, ranking, threads
from threadloom.operators.filters import SearchQuery
from threadloom.sources import landed, store
from threadloom.streaming import ingest


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*(F.col(n) for n in names))).first()[0]


@pytest.mark.parametrize(
    ("message", "norm"),
    [
        ("expected 768 features, got 1024", "expected <n> features, got <n>"),
        ("at 0x7f3a2b1c object", "at 0x? object"),
        ("failed in /home/me/checkout/src/mod.py", "failed in mod.py"),
        ("tensor([0.11, 0.22, 0.33, 0.44]) mismatch", "tensor([<values>]) mismatch"),
        ("expected  4\n  got 5", "expected <n> got <n>"),
        ("see [torch.nn](https://x.org/a) now", "see torch.nn now"),
    ],
)
def test_error_norm(spark, message, norm):
    assert one(spark, text.error_norm, message) == norm


def test_error_query_form(spark):
    pasted = 'Traceback:\n  File "a.py", line 3, in f\nValueError: expected 4 features, got 5\n'
    assert one(spark, text.error_query_form, pasted) == "expected <n> features, got <n>"
    assert one(spark, text.error_query_form, 'Traceback:\n  File "loader.py", line 12, in load\n') == 'file "loader.py", line <n>, in load'
    assert one(spark, text.error_query_form, "cuda out of memory") == "cuda out of memory"


@pytest.mark.parametrize(
    ("found", "path"),
    [("/home/me/checkout/src/mod.py", None), ("/usr/lib/python3.10/site-packages/torch/nn/mod.py", "torch/nn/mod.py"), ("a/src/x.py", "src/x.py"), ("./src/x.py", "src/x.py"), ("../x.py", None), ("e.g", None), ("webapp.py", "webapp.py"), ("docs/readme", None), ("`src/y.rs`,", "src/y.rs")],
)
def test_repo_path(spark, found, path):
    assert one(spark, text.repo_path, found) == path


@pytest.mark.parametrize(("word", "yes"), [("MyConfig.use_cache", True), ("webapp.py", False), ("true", False), ("main", False), ("use_cache", True), ("camelCase", True), ("ab", False), ("3d_x", False)])
def test_is_symbol(spark, word, yes):
    assert one(spark, text.is_symbol, word) is yes
    assert ranking.looks_like_symbol(word) is yes


def test_extraction(spark):
    body = 'look at `webapp.py` and `MyConfig.use_cache`\n  File "src/mod.py", line 412, in forward\ntests/test_mod.py::TestMask::test_shapes[cuda] fails\ntorch.cuda.OutOfMemoryError: CUDA out of memory\nFAILED tests/t.py::test_a - KeyError: \'mask\'\nFixes #12 and closes: #7, see #9'
    df = spark.createDataFrame([(7, body, "pr", "body")], "number long, body string, thread_type string, source_type string")
    got = lambda rows: {tuple(r)[1:] for r in rows.collect()}
    assert got(extract.errors(df, df["body"], "number")) == {("OutOfMemoryError", "cuda out of memory"), ("KeyError", "'mask'")}
    assert {("tests/test_mod.py::TestMask::test_shapes[cuda]", "test_shapes"), ("tests/test_mod.py::TestMask::test_shapes", "test_shapes"), ("tests/t.py::test_a", "test_a")} == got(extract.tests(df, df["body"], "number"))
    assert {("src/mod.py",), ("webapp.py",), ("tests/test_mod.py",), ("tests/t.py",)} == got(extract.paths(df, df["body"], "number"))
    assert {("forward", "src/mod.py", "frame"), ("MyConfig.use_cache", None, None)} == got(extract.symbols(df, df["body"], "number"))
    assert {(12,)} == got(extract.links(df, df["body"], "number"))


def test_redaction_reaches_split_secrets(spark):
    token = "ghp_" + "a" * 36
    for split in ("​", "‮", " ", "\u0007"):
        assert one(spark, text.redact, f"x {token[:9]}{split}{token[9:]} y") == "x [REDACTED:github-token] y"
    again = one(spark, text.redact, f"{token} https://me:pw@h/x")
    assert one(spark, text.redact, again) == again == "[REDACTED:github-token] https://me:[REDACTED:url-credentials]@h/x"
    assert one(spark, text.scrub, "<|im_start|> [INST] <<SYS>> <<< /threadloom x>>>") == "[SCRUBBED:special-token im_start] [SCRUBBED:special-token INST] [SCRUBBED:special-token SYS] [SCRUBBED:delimiter]"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n#", max_size=120), st.integers(5, 30))
def test_chunks_lose_no_text_and_keep_the_limit(body, most):
    chunks = chunks_of(body, most=most)
    assert all(0 < len(c) <= most for c in chunks)
    assert "".join("".join(chunks).split()) == "".join(body.split())


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "motoring": "motor", "hopping": "hop", "relational": "relat", "vietnamization": "vietnam", "formalize": "formal", "adjustable": "adjust", "adoption": "adopt", "rate": "rate", "cease": "ceas", "controlling": "control"}
    assert {w: stem(w) for w in pairs} == pairs


def test_requests_are_checked():
    for bad in ({"kind": "x"}, {"trust": "x"}, {"sort": "x"}, {"match": "x"}, {"since": datetime(2020, 1, 1)}, {"since": datetime(2021, 1, 1, tzinfo=UTC), "before": datetime(2020, 1, 1, tzinfo=UTC)}):
        with pytest.raises(ValueError):
            SearchQuery(**bad).checked()
    q = SearchQuery(limit=99, authors=("@A ", "a", "")).checked()
    assert q.limit == schemas.MAX_HITS and q.authors == ("a",)


def test_expansion_keeps_the_question_and_the_caps():
    legs = ranking.expanded(SearchQuery(text="`Foo.bar` fails in src/x_y.py: ValueError: bad thing_a thing_b thing_c"))
    assert legs[0].name == "text" and len(legs) <= schemas.MAX_LEGS
    names = [leg.name.split(":")[0] for leg in legs]
    assert names.count("symbol") <= 2 and "error" in names and "file" in names
    assert not any("x_y" in v for leg in legs for v in leg.query.symbols)


def raw_rows():
    user = {"login": "ann", "id": 1, "type": "User"}
    bot = {"login": "codecov", "id": 2, "type": "Bot"}
    at = "2025-01-0{}T00:00:00Z".format
    rows = []

    def put(kind, oid, of, **payload):
        rows.append(("org/r", kind, str(oid), of, json.dumps(payload)))

    put("issue", 1, 1, number=1, title="cache is wrong", body="KeyError: 'mask' in src/cache.py", state="open", user=user, author_association="NONE", labels=[{"name": "bug"}], created_at=at(1), updated_at=at(2))
    for n, verb in ((10, "Fixes #1"), (11, "Closes #1")):
        put("pr", n, n, number=n, title=f"mend cache {n}", body=f"{verb} with `Cache.get_mask`", state="open", user=user, author_association="OWNER", labels=[], created_at=at(3), updated_at=at(4), pull_request={"html_url": "x"})
    put("pr", 5, 5, number=5, title="older change", body="touches the cache", state="closed", user=user, author_association="MEMBER", labels=[], created_at=at(1), updated_at=at(2), pull_request={"html_url": "x", "merged_at": at(2)})
    for n in (5, 10):
        put("pr_details", n, n, number=n, files={"totalCount": 1, "nodes": [{"path": "src/cache.py", "changeType": "MODIFIED"}]}, commits={"totalCount": 1, "nodes": [{"commit": {"oid": f"{n:040d}", "messageHeadline": "c"}}]})
    put("issue_comment", 100, None, id=100, body="the cache mask is wrong because of the key", user=user, author_association="OWNER", created_at=at(5), updated_at=at(5), issue_url="https://h/repos/org/r/issues/1")
    put("issue_comment", 101, None, id=101, body="coverage of the cache fell", user=bot, author_association="NONE", created_at=at(5), updated_at=at(5), issue_url="https://h/repos/org/r/issues/1")
    put("review_comment", 102, None, id=102, body="nit", user=user, author_association="OWNER", created_at=at(6), updated_at=at(6), pull_request_url="https://h/repos/org/r/pulls/10", path="Dockerfile", line=3, diff_hunk="+def get_mask():")
    return rows


@pytest.fixture(scope="module")
def engine(spark):
    raw = spark.createDataFrame(raw_rows(), "repo string, object_type string, object_id string, thread_number long, payload string").withColumns({"fetched_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
    authority = spark.createDataFrame([("org/r", "ann", "write")], "repo string, login string, permission string")
    return Engine.over(spark, raw, authority)


def test_batches_are_indexed_once_and_forget_what_is_gone(spark):
    from threadloom.plans import index

    schema = "repo string, object_type string, object_id string, thread_number long, payload string"
    at = lambda rows, when: spark.createDataFrame(rows, schema).withColumns({c: F.lit(when).cast("timestamp") for c in ("fetched_at", "updated_at")})
    authority = spark.createDataFrame([("org/r", "ann", "write")], "repo string, login string, permission string")
    rows = [r for r in raw_rows() if json.loads(r[4]).get("number") == 1 or r[1].endswith("comment")]
    first = at(rows, "2025-02-01 00:00:00")
    marks = spark.createDataFrame([], "repo string, high_water timestamp")
    none = first.limit(0)
    one = index.indexed(none, first, index.derive.documents(index.derive.sources(none), authority), authority, marks)
    keys = {(r.source_type, r.source_id) for r in one.documents.collect()}
    assert keys == {("title", 1), ("body", 1), ("issue_comment", 100), ("issue_comment", 101), ("review_comment", 102)}
    assert {r.action for r in one.changes.collect()} == {"insert"} and one.history.count() == 0
    again = index.indexed(one.staged, first, one.documents, authority, one.marks)
    assert {r.action for r in again.changes.collect()} == {"unchanged"} and again.history.count() == 0
    changed = [(*r[:4], r[4].replace("KeyError", "TypeError\\u0000")) if r[1] == "issue" else r for r in rows if r[2] != "101"]
    failed = spark.createDataFrame([("org/r", "2025-02-02 00:00:00", True), ("org/r", "2025-02-03 00:00:00", False), ("org/r", "2025-02-04 00:00:00", True)], "repo string, ts string, ok boolean").withColumn("ts", F.to_timestamp("ts"))
    two = index.indexed(one.staged, at(changed, "2025-02-02 00:00:00"), one.documents, authority, one.marks, failed)
    assert {(r.source_type, r.source_id, r.action) for r in two.changes.collect() if r.action != "unchanged"} == {("body", 1, "update"), ("issue_comment", 101, "delete")}
    assert {(r.source_id, r.reason) for r in two.history.collect()} == {(1, "edited"), (101, "deleted")}
    assert "TypeError:" in {r.source_type: r.body_text for r in two.documents.collect()}["body"] and two.staged.count() == len(changed)
    assert str(two.marks.first().high_water) == "2025-02-02 00:00:00"


def test_closing_references_of_the_forge_are_links(spark):
    from threadloom.plans import derive

    node = lambda n, repo: {"number": n, "repository": {"nameWithOwner": repo}}
    rows = [("org/r", "pr_details", "7", 7, json.dumps({"number": 7, "closingIssuesReferences": {"nodes": [node(3, "Org/R"), node(4, "other/r"), node(7, "org/r")]}}))]
    raw = spark.createDataFrame(rows, "repo string, object_type string, object_id string, thread_number long, payload string").withColumns({"fetched_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
    assert [(r.number, r.target_number) for r in derive.signals(derive.sources(raw), raw)["links"].collect()] == [(7, 3)]


def test_engine_searches_and_widens(engine):
    page, widened = engine.search("cache mask", kind="failure")
    found = [(r.number, r.source_type) for r in page.collect()]
    assert (1, "issue_comment") in found and not widened
    assert all(r.trust != "machine" for r in page.collect())
    page, widened = engine.search("cache nowhere_to_be_found", files=())
    assert widened and page.count()
    assert engine.search("!!")[0].count() == 0
    assert engine.search("cache", repos=())[0].count() == 0


def test_engine_reads_threads_and_work_in_flight(engine):
    t = engine.thread("org/r", 1)
    assert t["head"].first().title == "cache is wrong" and t["comments"].count() == 1 and t["people"].first().machine_comments == 1
    assert {r.number for r in engine.inflight("org/r", 1).collect()} == {10, 11}
    b = engine.brief("org/r", 10)
    assert [r.target_number for r in b["closes"].collect()] == [1]
    assert [r.number for r in b["competing"].collect()] == [11]
    assert [r.number for r in b["file_history"].collect()] == [5]
    files = {r.path: r.source for r in engine.thread("org/r", 10)["files"].collect()}
    assert files == {"src/cache.py": "changed", "Dockerfile": "comment"}
    blamed = engine.spark.createDataFrame([("org/r", f"{5:040d}", "c"), ("org/r", "f" * 40, "fix (#10)")], "repo string, sha string, summary string")
    assert {(r.number, r.guessed) for r in engine.why(blamed).collect()} == {(5, False), (10, True)}
    assert engine.status().first().threads == 4


def test_question_and_index_are_analysed_alike(engine):
    page, widened = engine.search("get_mask", kind=None)
    assert not widened and {r.number for r in page.collect()} >= {10, 11}
    page, widened = engine.search("touching the caches", kind=None)
    assert not widened and 5 in {r.number for r in page.collect()}


def test_a_saved_engine_answers_from_its_tables(engine, tmp_path):
    saved = engine.saved(f"{tmp_path}/engine")
    for words in ("get_mask", "touching the caches", "cache nowhere_to_be_found", "the of"):
        mine, theirs = engine.search(words), saved.search(words)
        key = lambda page: [(r.number, r.source_type, r.source_id, round(r.score, 9)) for r in page.collect()]
        assert key(mine[0]) == key(theirs[0]) and mine[1] == theirs[1]
    plan = saved.postings.postings(["cach"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(term_bucket" in plan or "PartitionFilters: [term_bucket" in plan


def test_a_file_leg_is_ranked_by_the_words_of_the_caller(engine):
    from threadloom.operators import fulltext

    q = SearchQuery(text="mend nothing_like_it", files=("src/cache.py",), match="any")
    page, _ = ranking.search(engine.corpus, q, engine.postings, terms_of=fulltext.asked_english)
    assert page.first().number == 10


def test_brief_and_claims_stay_in_their_repository(spark):
    from threadloom.operators import provenance

    threads_ = spark.createDataFrame([(r, n, "open", None, None) for r in "ab" for n in (1, 2)], "repo string, number long, state string, created_at timestamp, merged_at timestamp")
    links = spark.createDataFrame([("a", 2, 1)], "repo string, number long, target_number long")
    assert [(r.repo, r.number) for r in threads.claims(links, threads_).collect()] == [("a", 2)]
    files = spark.createDataFrame([("a", 1, "x.py", "changed"), ("b", 2, "x.py", "changed")], "repo string, number long, path string, source string")
    merged = threads_.withColumn("merged_at", F.current_timestamp())
    assert provenance.file_history(files, merged, files).count() == 0 and provenance.file_histories(files, merged).count() == 0


def test_caps_of_a_page(spark):
    rows = [(1, "issue_comment", i, 1.0, None) for i in range(50)] + [(1, s, 99, 0.5, None) for s in ("title", "body", "review", "review_comment")] + [(n, "body", 1, 0.1, None) for n in range(2, 30)]
    df = spark.createDataFrame(rows, "number long, source_type string, source_id long, score double, created_at timestamp")
    page = ranking.select_page(df, ["number"], [F.col("source_id").desc()]).collect()
    assert len(page) == schemas.MAX_HITS and sum(r.number == 1 for r in page) == schemas.MAX_HITS_PER_THREAD
    assert len({(r.number, r.source_type) for r in page}) == len(page)


def test_cutoff_is_strict_and_closed_to_undated(spark):
    df = spark.createDataFrame([(1, "2020-01-01"), (2, "2020-01-02"), (3, "2020-01-03"), (4, None)], "number long, d string").withColumns({"created_at": F.to_timestamp("d"), "repo": F.lit("r")})
    assert [r.number for r in df.where(filters.in_scope(("r",), datetime(2020, 1, 2, tzinfo=UTC))).collect()] == [1]
    assert df.where(filters.in_scope(())).count() == 0


def test_ends_and_middle_prefers_reviews(spark):
    df = spark.createDataFrame([(1, i, i % 7 == 0) for i in range(60)], "number long, i long, review boolean")
    got = sorted(r.i for r in threads.ends_and_middle(df, ["number"], [F.col("i")], F.col("review")).collect())
    assert len(got) == schemas.MAX_COMMENTS and got[:2] == [0, 1] and got[-2:] == [58, 59]
    assert sum(i % 7 == 0 for i in got[2:-2]) == 6


def test_reconcile_writes_nothing_when_nothing_changed(spark):
    rows = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2")], "id long, body_text string, content_hash string")
    actions = lambda new: {r.action: r["count"] for r in store.change_set(rows, new, ["id"], ["content_hash"]).groupBy("action").count().collect()}
    assert actions(rows) == {"unchanged": 2}
    edited = spark.createDataFrame([(1, "a2", "h9"), (3, "c", "h3")], rows.schema)
    assert actions(edited) == {"update": 1, "insert": 1, "delete": 1}
    assert {(r.id, r.reason) for r in store.superseded(rows, edited, ["id"], "content_hash").collect()} == {(1, "edited"), (2, "deleted")}


def test_marks_stop_at_the_first_failure(spark):
    df = spark.createDataFrame([(1, 10, True), (1, 20, False), (1, 30, True), (2, 5, True)], "k long, ts long, ok boolean")
    assert {(r.k, r.high_water, r.held) for r in ingest.committed_mark(df, ["k"]).collect()} == {(1, 10, 1), (2, 5, 0)}


def test_tree_and_pages(spark, tmp_path):
    for name in ("a.py", ".git/x.py", "node_modules/y.py", "pkg/b.py"):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text("x = 1\n")
    assert sorted(r.path for r in landed.source_tree(spark, f"file://{tmp_path}/t").collect()) == ["a.py", "pkg/b.py"]
    for p in (1, 2, 3):
        (tmp_path / f"page-{p:05d}.jsonl").write_text(json.dumps({"updated_at": f"2025-01-0{p}"}) + "\n")
    spark.dataSource.register(landed.PagedSource)
    got = spark.read.format("threadloom_pages").options(path=str(tmp_path), pages=3, per_partition=2, since="2025-01-02").load()
    assert sorted(r.page for r in got.collect()) == [2, 3]


def test_scores_of_retrieval(spark):
    results = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (2, 6, 9)], "question long, rank long, item long")
    relevant = spark.createDataFrame([(1, 8), (2, 9), (3, 1)], "question long, item long")
    r = evaluation.retrieval_scores(results, relevant, []).first()
    assert (r.questions, round(r.recall_5, 4), round(r.recall_10, 4), round(r.mrr, 4)) == (3, 0.3333, 0.6667, round((1 / 2 + 1 / 6) / 3, 4))


def test_export_is_in_order_and_its_digest_stable(spark, tmp_path):
    df = spark.createDataFrame([("r", 2, "body", 1, 0, "b"), ("r", 1, "body", 1, 0, "a")], "repo string, number long, source_type string, source_id long, chunk_index int, text string")
    digest = evaluation.export(df, f"{tmp_path}/x")
    assert digest == evaluation.export(df.repartition(3, "text"), f"{tmp_path}/x")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/x").collect()]
    assert lines[0] == {"dataset": "corpus", "rows": 2, "digest": digest} and [x["number"] for x in lines[1:]] == [1, 2]
    assert evaluation.export(df.limit(1), f"{tmp_path}/x") != digest
