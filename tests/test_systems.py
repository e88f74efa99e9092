"""Systems that answer sets of questions, and their report."""

import pytest
from pyspark.sql import functions as F

from threadloom.operators import fulltext, systems


def test_files_that_hold_a_term(spark):
    texts = {"a": "import cache\nraise KeyError('mask')", "b": "KEYERROR é☃", "c": None, "d": "", "e": "a.b*c (x)", "f": "ab"}
    terms = ["KeyError('mask')", "KeyError", "é☃", "☃", "b*c", "ab", "cache\n", "a", "no such thing", "x"]
    files = spark.createDataFrame(list(texts.items()), "path string, content string")
    got = {tuple(r) for r in systems.files_with(files, spark.createDataFrame([(t,) for t in terms + terms], "term string")).select("path", "term").collect()}
    assert got == {(p, t) for p, text in texts.items() if text for t in terms if t in text}
    assert systems.files_with(files, spark.createDataFrame([], "term string")).count() == 0


def test_terms_of_a_grep(spark):
    rows = [("the mask is wrong here", ["KeyError <p> in the long literal here", "short"], ["tests/t.py::test_x"], ["A.b", "tests/t.py::test_x"]), ("a an mask", None, None, []), (None, None, None, None)]
    df = spark.createDataFrame(rows, "query string, errors array<string>, tests array<string>, symbols array<string>")
    got = [r.t for r in df.select(systems.grep_terms(*map(F.col, ("query", "errors", "tests", "symbols"))).alias("t")).collect()]
    assert got == [["in the long literal here", "tests/t.py::test_x", "A.b"], ["mask"], []]


def test_grep_weights_threads(spark):
    files = spark.createDataFrame([("p", "one two"), ("q", "one"), ("r", "three")], "path string, content string")
    asked = spark.createDataFrame([("x", ["one", "two"]), ("y", ["none"]), ("z", [])], "question string, terms array<string>")
    of = spark.createDataFrame([("p", 1), ("q", 2), ("q", 3), ("q", 2), ("r", 9)], "path string, item long")
    assert sorted(map(tuple, systems.grep_system(files, asked, of).collect())) == [("x", 1, 1), ("x", 2, 2), ("x", 3, 3)]


def test_report(spark):
    results = spark.createDataFrame([("index", "q1", 7, 1), ("index", "q1", 7, 2), ("index", "q1", 8, 3), ("index", "q2", 1, 1), ("grep", "q2", 5, 9)], "system string, question string, item long, rank int")
    relevant = spark.createDataFrame([("q1", 8), ("q2", 1), ("q2", 5), ("q2", 5)], "question string, item long")
    examples = spark.createDataFrame([("q1", "failure", None), ("q2", "rationale", False), ("q3", "rationale", True)], "question string, slice string, leaks boolean")
    rows = systems.report(results, relevant, examples, {"index": "bm25", "grep": None}, "bm25")
    got = {(r.system, r.slice, r.leak_free): (r.questions, r.recall_5, r.recall_10, r.mrr, r.empty) for r in rows.collect()}
    assert got == {
        ("index", "failure", False): (1, 1.0, 1.0, 0.5, 0), ("grep", "failure", False): (1, 0.0, 0.0, 0.0, 1),
        ("index", "rationale", False): (2, 0.25, 0.25, 0.5, 1), ("index", "rationale", True): (1, 0.5, 0.5, 1.0, 0),
        ("grep", "rationale", False): (2, 0.25, 0.25, 0.5, 1), ("grep", "rationale", True): (1, 0.5, 0.5, 1.0, 0),
    }
    with pytest.raises(ValueError, match="bm25, not"):
        systems.report(results, relevant, examples, {"index": "cover"}, "bm25")


def test_a_set_of_questions_reads_the_texts_for_its_own_terms(spark):
    """Postings of asked terms are those of an index, with the totals of all documents; what is asked of them is not dealt a row a question."""
    docs = spark.createDataFrame([(1, "a b a c"), (2, "c"), (3, ""), (4, None), (5, "b d")], "doc_id long, text string")
    asked = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "b"), ("y", "none")], "question string, term string")
    every = fulltext.postings(docs)
    found = fulltext.postings(docs, only=asked.select("term").distinct())
    shown = lambda rows: sorted(map(tuple, rows.select("doc_id", "term", "tf", "doc_len").collect()))
    assert shown(found.where("term <> ''")) == shown(every.where("term in ('a', 'b')"))
    total = fulltext.totals(found.where("term = ''"))
    assert tuple(total.first()) == tuple(fulltext.totals(every).first())
    ranked = systems.index_system(found, asked, total)
    assert sorted(map(tuple, ranked.collect())) == sorted(map(tuple, systems.index_system(every, asked, fulltext.totals(every)).collect())) == [("x", 1, 1), ("x", 5, 2), ("y", 1, 2), ("y", 5, 1)]
    assert "deal" not in ranked._jdf.queryExecution().optimizedPlan().toString()


def test_pieces_are_cut_once_for_terms_without_blanks(spark):
    """Without terms of several words no second search is planned, and pieces too short for any term are left out."""
    files = spark.createDataFrame([(1, "the cache is a mask"), (2, "xmaskx a"), (3, None)], "path long, content string")
    seen = {}
    found = systems.files_with(files, spark.createDataFrame([("mask",), ("cache",)], "term string"), stage=lambda rows, name: seen.setdefault(name, rows))
    assert sorted(map(tuple, found.collect())) == [(1, "cache"), (1, "mask"), (2, "mask")]
    assert sorted(r[0] for r in seen["pieces"].collect()) == ["cache", "mask", "xmaskx"]
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
