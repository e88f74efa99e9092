"""The segmented index: positions, covers, batches, merges; and searches that read no bodies before their limit."""

import re
from itertools import combinations, product
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import fulltext, ranking, segments
from threadloom.operators.filters import Corpus, SearchQuery
from threadloom.schemas import ENGLISH_STOPWORDS


def shortest_covers(words, asked):
    """All stretches with every term that hold no shorter one, by trying all."""
    places = {t: [i for i, w in enumerate(words) if w == t] for t in asked}
    spans = {(min(p), max(p)) for p in product(*places.values())}
    return [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]


def test_cover_density_is_the_sum_over_shortest_covers(spark):
    draw = np.random.default_rng(8)
    texts = [(i, " ".join(draw.choice(list("abcdx"), draw.integers(0, 14)))) for i in range(60)]
    found = segments.positional(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text")
    for asked in [("a",), ("a", "b"), ("a", "b", "c")]:
        got = {r["doc_id"]: r["score"] for r in segments.cover_density(found, asked).collect()}
        want = {}
        for i, text in texts:
            words = text.split()
            if set(asked) <= set(words):
                want[i] = sum(0.1 / (1 + sum(w not in asked for w in words[s : e + 1])) for s, e in shortest_covers(words, asked))
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_stopwords_keep_their_places(spark):
    docs = spark.createDataFrame([(1, "Running the tests of the cache"), (2, "running tests"), (3, "the of"), (4, None)], "doc_id long, text string")
    found = segments.positional(docs, "doc_id", "text", stopwords=ENGLISH_STOPWORDS, stemming=True)
    assert sorted((r["doc_id"], r["term"], r["positions"], r["doc_len"]) for r in found.collect()) == [(1, "cach", [5], 3), (1, "run", [0], 3), (1, "test", [2], 3), (2, "run", [0], 2), (2, "test", [1], 2)]
    near = {r["doc_id"]: r["score"] for r in segments.cover_density(found, ["run", "test"]).collect()}
    assert near[1] == 0.05 and near[2] == 0.1


def contents(index):
    terms = list("abcdefgh")
    rows = [(r["doc_id"], r["term"], tuple(r["positions"]), r["doc_len"], r["tag"]) for r in index.postings(terms).collect()]
    return sorted(rows), {r["term"]: r["df"] for r in index.frequencies(terms).collect() if r["df"]}, tuple(index.total().first())


def files_of(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_batches_equal_a_rebuild_and_leave_old_segments_alone(spark, tmp_path):
    draw = np.random.default_rng(3)
    now = {}
    index = segments.Segments(spark, str(tmp_path / "index"))
    for n in range(4):
        batch = []
        for key in draw.choice(30, 12, replace=False):
            gone = bool(now.get(key)) and draw.random() < 0.3
            text = " ".join(draw.choice(list("abcdefgh"), draw.integers(0, 6)))
            batch.append((int(key), text, f"v{n}", gone))
            now[key] = None if gone else (text, f"v{n}")
        before = files_of(tmp_path / "index")
        index.append(spark.createDataFrame(batch, "doc_id long, text string, tag string, gone boolean"), facets=["tag"], gone=F.col("gone"))
        after = files_of(tmp_path / "index")
        assert before.items() <= after.items()  # nothing older was written again
        fresh = segments.Segments(spark, str(tmp_path / f"fresh{n}"))
        fresh.append(spark.createDataFrame([(int(k), *v) for k, v in now.items() if v], "doc_id long, text string, tag string"), facets=["tag"])
        assert contents(index) == contents(fresh)
    whole = contents(index)
    index.merged(index.segments()[:2])
    assert contents(index) == whole and len(index.segments()) == 3
    index.merged()
    assert contents(index) == whole and len(index.segments()) == 1
    with pytest.raises(ValueError):
        index.append(spark.createDataFrame([(99, "a", "x")], "doc_id long, text string, tag string"), facets=["tag"])
        index.merged(index.segments()[1:])


def test_a_batch_that_died_is_not_seen(spark, tmp_path):
    index = segments.Segments(spark, str(tmp_path))
    index.append(spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, tag string"), facets=["tag"])
    seen = contents(index)
    half = segments.positional(spark.createDataFrame([(1, "c", "y")], "doc_id long, text string, tag string"), "doc_id", "text", ["tag"]).withColumn("age", F.lit(1))
    index._write(1, "postings", half.withColumn("term_bucket", segments.bucket_of(F.col("term"))), "term_bucket")
    index._write(1, "retired", spark.createDataFrame([(1, 1)], "doc_id long, by int"))
    assert contents(index) == seen
    index.append(spark.createDataFrame([(1, "d", "z")], "doc_id long, text string, tag string"), facets=["tag"])
    assert contents(index)[0] == [(1, "d", (0,), 1, "z")]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    draw = np.random.default_rng(1)
    kinds = ["title", "body", "issue_comment", "review"]
    rows = []
    for n in range(40):
        for c in range(4):
            rows.append((f"org/r{n % 3}", n, kinds[c], n * 10 + c, 0, f"u{n % 5}", False, ["authoritative", "reported", "machine"][n % 3], " ".join(draw.choice(["cache", "mask", "error", "token", "the", "slow"], 12))))
    schema = "repo string, number long, source_type string, source_id long, chunk_index int, author string, author_is_bot boolean, trust string, body_text string"
    docs = spark.createDataFrame(rows, schema).withColumn("created_at", F.expr("timestamp '2020-01-01' + make_dt_interval(cast(number as int))")).withColumn("doc_key", F.concat_ws(":", "repo", "number", "source_id"))
    docs = docs.withColumns({"body_markdown": F.upper("body_text"), "doc_bucket": ranking.doc_bucket(F.col("repo"), F.col("number"))})
    folder = tmp_path_factory.mktemp("corpus")
    docs.write.partitionBy("doc_bucket").parquet(f"{folder}/documents")
    threads = spark.createDataFrame([(f"org/r{n % 3}", n, "pr" if n % 2 else "issue", f"u{n % 7}", "open") for n in range(40)], "repo string, number long, thread_type string, author string, state string").withColumn("merged_at", F.lit(None).cast("timestamp"))
    threads.write.parquet(f"{folder}/threads")
    index = segments.Segments(spark, f"{folder}/index", "doc_key")
    read = spark.read.parquet(f"{folder}/documents")
    index.append(read, "body_text", ranking.FACETS)
    return Corpus(spark.read.parquet(f"{folder}/threads"), read), index, fulltext.postings(read, "doc_key", "body_text")


QUERIES = [SearchQuery("cache mask"), SearchQuery("slow token error", repos=("org/r1",)), SearchQuery("cache absent", trust="machine"), SearchQuery("the mask", authors=("u2",), sort="newest"), SearchQuery("error", exclude=(3, 4))]


@pytest.mark.parametrize("q", QUERIES)
def test_facets_choose_the_same_page_as_documents(corpus, q):
    c, index, postings = corpus
    got, want = (ranking.search(c, q, p) for p in (index, postings))
    shown = lambda page: [(r["doc_key"], round(r["score"], 9), r["body_text"], r["body_markdown"]) for r in page.collect()]
    assert got[1] == want[1] and shown(got[0]) == shown(want[0]) and got[0].count()


def test_bodies_are_read_after_the_limit_and_in_their_folders(corpus, spark):
    c, index, _ = corpus
    page, _ = ranking.search(c, SearchQuery("cache mask"), index)
    plan = page._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    documents = [x for x in re.findall(r"FileScan parquet .*", plan) if "body_" in x]
    assert len(documents) == 1 and "dynamicpruning" in documents[0]
    assert not [x for x in re.findall(r"FileScan parquet .*", plan) if "/documents]" in x and "index" not in x and "body_" not in x]  # no other scan of documents


def test_density_ranks_near_terms_first(spark, tmp_path):
    rows = [("o/r", 1, "title", 1, 0, "u", False, "reported", "alpha x x x x x x beta"), ("o/r", 2, "title", 2, 0, "u", False, "reported", "alpha beta x x x x x x")]
    docs = spark.createDataFrame(rows, "repo string, number long, source_type string, source_id long, chunk_index int, author string, author_is_bot boolean, trust string, body_text string")
    docs = docs.withColumns({"created_at": F.lit("2020-01-01").cast("timestamp"), "doc_key": F.col("number").cast("string")})
    threads = spark.createDataFrame([("o/r", 1), ("o/r", 2)], "repo string, number long").withColumns({"thread_type": F.lit("pr"), "author": F.lit("a"), "merged_at": F.lit(None).cast("timestamp")})
    index = segments.Segments(spark, str(tmp_path), "doc_key")
    index.append(docs, "body_text", ranking.FACETS)
    page, widened = ranking.search(Corpus(threads, docs), SearchQuery("alpha beta"), index, how="density")
    assert [r["number"] for r in page.collect()] == [2, 1] and not widened
    wide, widened = ranking.search(Corpus(threads, docs), SearchQuery("alpha beta gamma"), index, how="density")
    assert widened and {r["number"] for r in wide.collect()} == {1, 2}


def test_some_combinations_have_no_cover():
    assert all(not shortest_covers(["a"], pair) for pair in combinations("abc", 2))
