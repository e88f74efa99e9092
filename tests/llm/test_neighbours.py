"""Nearest neighbours against all cosines: recall, exact scores, order, and what takes no part."""

import numpy as np
import pytest

from threadloom.llm import neighbours as nn


def brute(ids, x, every, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        c = u @ u[i]
        order = [j for j in np.lexsort((ids, -np.round(c, 12))) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), c[j]) for j in order]
    return out


def frame(spark, ids, x, kind="double"):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], f"vec_id long, embedding array<{kind}>")


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_recall_over_many_cells(spark):
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.normal(size=(9000, 16)), draw.normal(size=(3000, 16)) * 0.05 + draw.normal(size=16)])
    ids = np.arange(len(x))
    want, got = brute(ids, x, 100, 5), results(nn.neighbours(frame(spark, ids, x), every=100))
    assert got.keys() == want.keys()
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == [1, 2, 3, 4, 5]
        assert all(abs(s - u[q] @ u[v]) < 1e-12 for _, v, s in rows)
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)


def test_few_rows_are_all_found(spark):
    draw = np.random.default_rng(2)
    for n in (1, 2, 4, 300):
        x, ids = draw.normal(size=(n, 8)), np.arange(n)
        got, want = results(nn.neighbours(frame(spark, ids, x), every=50)), brute(ids, x, 50, 5)
        if n == 1:
            assert got == {}
        elif n <= 6:
            assert [[v for _, v, _ in got[q]] for q in want] == [[v for v, _ in want[q]] for q in want]
        else:
            assert sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)


def test_copies_tie_to_the_smaller_key(spark):
    x = np.array([[1.0, 2.0, 3.0]] * 12 + [[3.0, 2.0, 1.0]])
    got = results(nn.neighbours(frame(spark, np.arange(13), x), every=50))
    assert [v for _, v, _ in got[0]] == [1, 2, 3, 4, 5] and len({s for _, _, s in got[0]}) == 1


def test_opposite_vectors_still_fill_the_result(spark):
    got = results(nn.neighbours(frame(spark, np.arange(4), np.array([[1.0, 0.0], [-1.0, 0.0], [-2.0, 0.0], [0.0, 1.0]])), every=50))
    assert [v for _, v, _ in got[0]] == [3, 1, 2]


def test_what_takes_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.1]), (50, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, uid string, score int")
    assert [(v, round(s, 9)) for _, v, s in results(nn.neighbours(df))[0]] == [(None, round(1 / np.sqrt(1.01), 9)), (1, round(np.sqrt(0.5), 9))]
    assert nn.neighbours(df.where("vec_id = 99")).collect() == []
    assert nn.neighbours(df.where("vec_id = 2")).collect() == []


def test_repeated_rows_find_each_other(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r["rank"], r["vec_id"]) for r in nn.neighbours(df).collect()) == [(1, 0), (1, 0), (2, 1), (2, 1)]


@pytest.mark.parametrize("scale", [1e-200, 1e200])
def test_squares_neither_vanish_nor_overflow(spark, scale):
    got = results(nn.neighbours(frame(spark, [0, 1], np.array([[3.0, 4.0], [4.0, 3.0]]) * scale)))
    assert abs(got[0][0][2] - 0.96) < 1e-12


def test_quantile():
    assert abs(nn.chi_square_quantile(0.95, 10) - 18.307) < 1e-3 and abs(nn.chi_square_quantile(0.5, 2) - 1.3863) < 1e-4


def test_the_search_stops_early():
    """Near vectors in a heap of others: far leaves are never verified."""
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.normal(size=(4000, 32)), np.ones((20, 32)) + 0.05 * draw.normal(size=(20, 32))])
    order, starts = nn.leaves(nn.projected(x))
    chunk = nn.Chunk(order, x[order], np.array(starts))
    seen = []
    true, nn.cosines = nn.cosines, lambda q, v: (seen.append(len(v)), true(q, v))[1]
    try:
        best, _ = chunk.nearest(x[4005], 4005, nn.projected(x[4005:4006])[0], 5, nn._NO_BOUND, nn.chi_square_quantile(nn.PROBABILITY, nn.PROJECTED))
    finally:
        nn.cosines = true
    assert all(order[best] >= 4000) and sum(seen) < 400
