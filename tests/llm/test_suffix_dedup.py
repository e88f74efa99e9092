import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import suffix_dedup


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, block int")
    return sorted((tuple(r) for r in suffix_dedup.digests(suffix_dedup.without_repeats(df, **how)).collect()), key=str)


def brute(rows):
    return sorted(suffix_dedup.brute_force([(i, (t or "").encode()) for i, t in rows]), key=str)


def make(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdefgh é漢\n") for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 70, 120, 400)]
    rows = [(i, "".join(r.choice([text(r.randrange(80)), r.choice(shared), r.choice(shared)[r.randrange(9) :]]) for _ in range(r.randrange(6)))) for i in r.sample(range(1000), 60)]
    rows += [(2000 + i, "=" * n) for i, n in enumerate((10, 49, 50, 51, 300, 5000))] + [(3000, "ab" * 400), (3001, "ba" * 300), (3002, None), (3003, ""), (3004, text(200_000)), (3005, rows[0][1]), (3006, rows[0][1])]
    return rows


def test_against_brute_force(spark):
    rows = make(1)
    assert run(spark, rows, block_bytes=700, bucket_bytes=5000) == brute(rows)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, block_bytes=700, heavy=3) == brute(rows)


def test_repeated_and_null_ids_and_empty_table(spark):
    passage = "the same passage of more than fifty bytes in all the documents here"
    got = run(spark, [(4, passage), (4, passage), (9, passage), (None, passage)])
    assert [r[2] for r in got if r[0] == 4] == [0, 0]
    assert [r[2] for r in got if r[0] == 9] == [len(passage)]
    assert [r[2] for r in got if r[0] is None] == [0]
    assert run(spark, []) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=4, max_size=4).map(lambda b: bytes(x & 3 for x in b)), min_size=1, max_size=12))
def test_the_blind_trie_sorts(strings):
    ranked = suffix_dedup.blind_trie([int.from_bytes(s, "big") for s in strings], 32)
    assert [strings[i] for i, _ in ranked] == sorted(strings)
    assert all((common == 32) == (strings[ranked[k][0]] == strings[ranked[k - 1][0]]) for k, (_, common) in enumerate(ranked) if k)


@pytest.mark.parametrize("trie", [0, 40, 10**6])
def test_deep_groups_are_sorted_like_plain_suffixes(monkeypatch, trie):
    monkeypatch.setattr(suffix_dedup, "TRIE", trie)
    r = random.Random(4)
    text = bytes(r.choice(b"ab") for _ in range(2500)) * 3 + b"a" * 300 + b"".join(b"common part of all" + bytes(r.choice(b"abc") for _ in range(12)) for _ in range(300))
    import numpy as np

    at = np.arange(len(text) - suffix_dedup.LENGTH + 1)
    order, equal = suffix_dedup.sorted_suffixes(text, at)
    found = [text[p : p + suffix_dedup.LENGTH] for p in at[order]]
    assert found == sorted(found)
    assert all(equal[k] == (found[k] == found[k - 1]) for k in range(1, len(found)))


def test_long_texts_have_the_same_stretches_in_parts():
    import numpy as np

    b = np.random.default_rng(1).integers(97, 101, 5000).astype(np.uint8)
    whole, parts = suffix_dedup.stretches(b), suffix_dedup.stretches(b, part=700)
    assert set(np.repeat(whole[0], whole[2] - whole[1])) == set(np.repeat(parts[0], parts[2] - parts[1]))
    assert (np.repeat(whole[0], whole[2] - whole[1]) == np.repeat(parts[0], parts[2] - parts[1])).all()
