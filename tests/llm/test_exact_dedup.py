import hashlib
import re
from collections import defaultdict

import pytest

from threadloom.llm import common, exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, kept string"


def brute(rows):
    digest = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    groups = defaultdict(list)
    for i, t in rows:
        groups[digest(t)].append(i)
    out = []
    for d, ids in groups.items():
        first = min((i is None, i or 0) for i in ids)[1] if any(i is not None for i in ids) else None
        out += [(i, first, len(ids), d) for i in ids]
    return sorted(out, key=str)


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "A b"), (1, ""), (2, None), (4, " "), (7, "x" * 300_000), (8, "x" * 300_000), (None, "a b"), (None, None), (11, "same"), (11, "same"), (11, "other"), (12, "ünï x"), (13, "ünï x")]


def test_groups_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in ROWS], SCHEMA)
    got = exact_dedup.exact_groups(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(ROWS)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_a_full_filter_changes_nothing_but_the_shuffle(spark):
    rows = [(i, f"text {i % 700}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    small = exact_dedup.exact_groups(docs, most_filter_bits=common.BLOCK_BITS)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, exact_dedup.exact_groups(docs).collect()))


def test_deduplicated_keeps_columns_and_one_of_each(spark):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in ROWS], SCHEMA)
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([3, 9, 1, 4, 7, 11, 11, 12, 13], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(docs).count() == 0
    assert exact_dedup.deduplicated(docs).count() == 0


@pytest.mark.parametrize("rows", [0, 1, 10**6, 10**12])
def test_the_filter_is_bounded(rows):
    assert common.BLOCK_BITS <= exact_dedup.filter_bits(rows) <= exact_dedup.MOST_FILTER_BITS
