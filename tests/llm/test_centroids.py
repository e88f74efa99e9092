"""Centroid clustering against plain integers, with components of any size."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from threadloom.llm import centroids


def plain(rows, k, rounds, seed=3):
    """The contract in Python integers: rows (id, components)."""
    whole = [(i, [math.floor(Fraction(v) * 1024) for v in x]) for i, x in rows]
    c = [x for _, x in sorted(whole, key=lambda r: hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest())[:k]]

    def nearest(x):
        d = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in c]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        at = [nearest(x)[0] for _, x in whole]
        for j in range(len(c)):
            own = [x for (_, x), a in zip(whole, at, strict=True) if a == j]
            if own:
                c[j] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    found = [(i, *nearest(x)) for i, x in whole]
    by = [sum(d for _, a, d in found if a == j) for j in range(len(c))]
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    fit = lambda v: v if v < 2**63 else None
    return sorted((i, a, fit(d), fit(by[a]), fit(sum(by)), digest[a]) for i, a, d in found)


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(tuple(r) for r in centroids.clustered(df, **more).collect())


@pytest.mark.parametrize("scale", [0.1, 3e4, 1e9, 1e20, 1e306])
def test_plain_integers(spark, scale):
    draw = np.random.default_rng(7)
    rows = [(i, [float(v) for v in draw.normal(size=5) * scale]) for i in range(40)]
    rows += [(100, [0.0] * 5), (101, [-0.0] * 5), (102, list(rows[3][1]))]
    assert found(spark, rows, size=5, k=4, rounds=6) == plain(rows, 4, 6)


def test_rows_of_all_sizes_meet_in_one_block(spark):
    rows = [(i, [float(i % 7), 1.0 / (i + 1)]) for i in range(30)] + [(30, [3e15, 1.0]), (31, [-4e200, 2.0])]
    assert found(spark, rows, size=2, k=3, rounds=10) == plain(rows, 3, 10)


def test_what_takes_no_part(spark):
    good = [(i, [float(i), 1.0]) for i in range(4)]
    bad = [(10, None), (11, []), (12, [1.0]), (13, [1.0, 2.0, 3.0]), (14, [None, 1.0]), (15, [float("nan"), 1.0]), (16, [float("inf"), 1.0]), (17, [float("-inf"), 1.0])]
    assert found(spark, good + bad, size=2, k=8, rounds=3) == plain(good, 8, 3)
    assert found(spark, bad, size=2) == []
    assert found(spark, [], size=2) == []


def test_equal_vectors_leave_clusters_empty(spark):
    rows = [(i, [1.5, -2.25]) for i in range(20)]
    assert {r[1] for r in found(spark, rows, size=2, k=8, rounds=4)} == {0}


def test_null_and_repeated_keys_and_extra_columns(spark):
    rows = [(None, [9.0, 9.0], 1, 2), (5, [0.0, 1.0], 3, 4), (5, [8.0, 8.0], 5, 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int, ids int")
    got = centroids.clustered(df, size=2, k=2, rounds=2)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((r["vec_id"] or -1, r["cluster"]) for r in got.collect()) == [(-1, 1), (5, 0), (5, 1)]


def test_distances_agree_in_every_arithmetic():
    draw = np.random.default_rng(1)
    x = np.floor(draw.normal(size=(50, 8)) * 1000)
    c = [[int(v) for v in np.floor(draw.normal(size=8) * 1000)] for _ in range(3)]
    want = [[sum((int(a) - b) ** 2 for a, b in zip(row, y, strict=True)) for y in c] for row in x]
    assert centroids.distances(x, c).tolist() == want
    assert centroids.distances(np.array([[int(v) for v in row] for row in x], dtype=object), c).tolist() == want
    huge = [[v + 2**70 for v in y] for y in c]
    assert centroids.distances(x, huge).tolist() == [[sum((int(a) - b) ** 2 for a, b in zip(row, y, strict=True)) for y in huge] for row in x]
