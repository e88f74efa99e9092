"""Trigram and path-tail indexes give what a scan gives, and read less."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.operators import codelens, filters, substrings
from threadloom.operators.filters import Corpus, SearchQuery

TEXTS = ["import os\nprint('Hello World')", "def run(a):\n    return a", "MIT License\nApache 2.0", "", "ab", "Straße ÜBER über", "x" * 400 + "needle" + "y" * 400, "\U0001f600 smile\U0001f600yes", None, "foo123bar\nfoo bar"]


def meets(condition, text):
    """The condition in plain Python."""
    low = text.translate(substrings._ASCII_LOWER)
    if condition is None:
        return True
    if isinstance(condition, str):
        return condition in low
    return (all if condition[0] == "and" else any)(meets(c, text) for c in condition[1])


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(TEXTS)], "path string, content string")


@pytest.fixture(scope="module")
def index(files, tmp_path_factory):
    return substrings.Trigrams.build(files, str(tmp_path_factory.mktemp("grams") / "t"), ["path"], "content")


PATTERNS = ["Hello", "(?i)hello\\s+world", "[Ll]icen[sc]e|print", "foo.*bar", "foo\\d+bar", "a", "[a-z]{3}", "^def run\\(", "needle", "nothing here", "(?:foo|def) ?(bar|run)", "(x)?y{2,}", "über", "\\QHello\\E", "smile.yes", "colou?r|MIT"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_grep_with_the_index_equals_the_scan(files, index, pattern):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(codelens.grep(files, pattern, most=None, index=index)) == rows(codelens.grep(files, pattern, most=None))


def test_patterns_without_trigrams_read_everything():
    for pattern in ("a", "[a-z]+", "x*abc?|.", "\\p{L}+foo", "(?x) f o o", "[a&&b]foo", "("):
        assert substrings.of_pattern(pattern) is None
    assert substrings.of_literal("ab") is None


def test_a_literal_is_looked_up(index, spark):
    found = index.candidates(substrings.of_literal("Hello World"))
    assert [r[0] for r in found.collect()] == ["p0"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket), ", "") and "PushedFilters: [In(gram" in plan


PIECE = st.sampled_from(["abc", "a", "b.c", "x?", "(ab|cd)", "[ab]", "[^a]", "ab+", "(?:abc)*", "c{2}", "\\w", "^", "$", "|", "AbC", "é"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECE, min_size=1, max_size=6).map("".join), st.text("abcdxABCé \n", max_size=30))
def test_no_match_is_lost(pattern, text):
    if re.search(pattern, text):
        assert meets(substrings.of_pattern(pattern), text)


def test_long_texts_are_cut_in_linear_time(spark):
    rows = spark.createDataFrame([("a" * 2_000_000 + "bcd",)], "t string").select(F.size(substrings.trigrams(F.col("t"))).alias("n"))
    assert rows.first()["n"] == 4


def test_filters_through_their_indexes(spark, tmp_path):
    heads = spark.createDataFrame([(n,) for n in range(6)], "number long").withColumns({"repo": F.lit("o/r"), "merged_at": F.lit(None).cast("timestamp"), "author": F.lit("a"), "thread_type": F.lit("pr")})
    docs = spark.createDataFrame([(n, "title", "u", "reported") for n in range(6)], "number long, source_type string, author string, trust string").withColumn("created_at", F.lit("2020-01-01").cast("timestamp"))
    files = spark.createDataFrame([(0, "src/a.py"), (1, "lib/src/a.py"), (2, "src/ba.py"), (3, "a.py"), (4, "src/a.pyc"), (5, None)], "number long, path string").withColumn("source", F.lit("changed"))
    errors = spark.createDataFrame([(0, "expected <n> features"), (1, "no such file"), (2, "Expected <n> features, got <n>"), (3, None)], "number long, message_norm string")
    plain = Corpus(heads, docs, files, errors=errors, key=("number",))
    indexed = Corpus(heads, docs, files, errors=errors, key=("number",), error_grams=substrings.Trigrams.build(errors, f"{tmp_path}/e", ["number"], "message_norm"), tails=substrings.PathTails.build(files, f"{tmp_path}/t"))
    for q in (SearchQuery(files=("src/a.py",)), SearchQuery(files=("./a.py", "ba.py")), SearchQuery(files=(" ",)), SearchQuery(errors=("ValueError: expected 12 features",)), SearchQuery(errors=("ile",), files=("a.py",)), SearchQuery(errors=("no", "zz"))):
        numbers = lambda c: sorted(r["number"] for r in filters.admissible(c, q).collect())  # noqa: E731, B023
        assert numbers(indexed) == numbers(plain)
    assert sorted(r["number"] for r in indexed.tails.matching(["src/a.py"]).collect()) == [0, 1]


def test_a_tail_is_a_range_of_the_sorted_table(spark, tmp_path):
    paths = spark.range(0, 20000, 1, 4).select(F.col("id").alias("number"), F.concat(F.lit("d"), F.col("id") % 97, F.lit("/f"), F.col("id"), F.lit(".py")).alias("path"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files, small as they are
    tails = substrings.PathTails.build(paths, f"{tmp_path}/tails")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = tails.matching(["f777.py"])
    assert [r["number"] for r in found.collect()] == [777]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(reversed" in plan and "EqualTo(reversed" in plan
    import pyarrow.parquet as pq

    groups = [pq.ParquetFile(f).metadata.row_group(0).column(2).statistics for f in sorted((tmp_path / "tails").glob("*.parquet"))]
    wanted = "yp.777f"
    assert len(groups) > 1 and sum(g.min <= wanted + "~" and g.max >= wanted for g in groups) == 1


def test_globs(spark):
    files = spark.createDataFrame([("a/b1.py",), ("a/b2.py",), ("a/bx.py",), ("a/b^.py",), ("[x].md",), ("a.b",), ("a&b",)], "path string")
    got = lambda p: sorted(r[0] for r in filters.globbed(files, p).collect())
    assert got("a/b[0-9].py") == ["a/b1.py", "a/b2.py"] and got("a/b[!0-9].py") == ["a/b^.py", "a/bx.py"] and got("a/b[x^].py") == ["a/b^.py", "a/bx.py"]
    assert got("[[]x].md") == ["[x].md"] and got("*.b") == ["a.b"] and got("a?b") == ["a&b", "a.b"] and got("[x") == []
