import random

import numpy as np
import pytest

from threadloom.llm import minhash


def sets_of(rows, size):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.setdefault(i, []).append(frozenset(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    return out


def brute(rows, size, percent=80):
    sets = sets_of(rows, size)
    nodes = [(i, s) for i, every in sets.items() for s in every if s and i is not None]
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(nodes):
        for j, b in nodes[:k]:
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) if i is not None else None for i in sets}


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, rep int, low string")
    return minhash.near_duplicates(df, **how).collect()


def edited(r, base, share):
    return " ".join(w if r.random() > share else f"e{r.randrange(10**6)}" for w in base)


@pytest.mark.parametrize("size", [2, 5])
def test_against_brute_force(spark, size):
    r = random.Random(size)
    bases = [[f"w{r.randrange(400)}" for _ in range(r.choice([3, 8, 60, 200]))] for _ in range(25)]
    rows = [(i, " ".join(r.choice(bases)) if i % 3 == 0 else edited(r, r.choice(bases), r.choice([0, 0.01, 0.03, 0.1]))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "ONE"), (205, "Ä b"), (206, "ä b"), (207, rows[0][1].upper()), (208, rows[0][1] + "\t"), (209, "long " * 200_000), (210, "long " * 200_001), (211, "x" * 3_000_000), (None, rows[0][1])]
    got, want, sizes = run(spark, rows, size=size), brute(rows, size), sets_of(rows, size)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles in [len(s) for s in sizes[r.doc_id]] for r in got)
    assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in got)


def test_one_large_group_of_near_copies(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, edited(r, base, 0.02)) for i in range(300)] + [(1000 + i, edited(r, base, 0.25)) for i in range(40)]
    got = run(spark, rows, size=2, cell=5000)
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 2)


def test_repeated_ids_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (2, "a b c d e f"), (3, "g h i j k l"), (3, "g h i j k l")]
    got = run(spark, rows, size=2)
    assert len(got) == 5 and {r.component_id for r in got} == {1}
    assert run(spark, []) == []


def test_a_repeated_id_links_its_texts_and_near_copies_of_any_of_them(spark):
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a[:59], "x"])), (3, " ".join([*b[:59], "y"]))]
    got = run(spark, rows, size=2)
    assert len(got) == 4 and {r.component_id for r in got} == {1}


def test_words_of_long_texts_are_those_of_the_whole(monkeypatch):
    texts = [b"Ab cD  e", b"", b" ", b"ab\x0b\x0cCD", b"x" * 50 + b" tail", b" lead and  trail "]
    whole = [minhash.words_of(t) for t in texts]
    for n in (1, 2, 3, 7):
        monkeypatch.setattr(minhash, "_SLICE", n)
        for t, (hashes, _) in zip(texts, whole, strict=True):
            assert [w for part in minhash._slices(t) for w in part] == t.lower().split()
            assert (minhash.words_of(t)[0] == hashes).all()


def test_digests_of_long_texts_do_not_depend_on_the_slices(monkeypatch):
    text = b"one  two\tthree " * 50
    want = minhash.words_of(text)[1]
    monkeypatch.setattr(minhash, "_SLICE", 11)
    assert minhash.words_of(text)[1] == want
