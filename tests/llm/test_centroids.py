import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobfacts.llm import centroids
from jobfacts.llm.centroids import LONG, Ptolemy, clusters, roots, squares


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def brute(rows, k, rounds, dims, scale=1024, seed=3):
    kept = []
    for ident, v in rows:
        if v is None or len(v) != dims or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((ident, [math.floor(x * scale) for x in v]))
    key = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centre = [v for _, v in sorted(kept, key=key)[:k]]
    for turn in range(rounds + 1):
        best = [min((apart(v, c), i) for i, c in enumerate(centre)) for _, v in kept]
        if turn < rounds:
            for i in range(len(centre)):
                mine = [v for (_, v), b in zip(kept, best, strict=True) if b[1] == i]
                if mine:
                    centre[i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    of = [sum(min(d, LONG) for d, i in best if i == c) for c in range(len(centre))]
    return sorted(
        (ident is None, ident or 0, i, min(d, LONG), min(of[i], LONG), min(sum(of), LONG), [str(x) for x in centre[i]])
        for (ident, _), (d, i) in zip(kept, best, strict=True)
    )


def got(df):
    return sorted((r[0] is None, r[0] or 0, *r[1:]) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    middles = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(6)]
    out = [(i, [x + rng.gauss(0, 0.4) for x in rng.choice(middles)]) for i in range(400)]
    out += [(900 + i, [0.25, -0.5, 0.0, 1.0, 2.0]) for i in range(80)]  # a third-size group of one vector
    out += [(None, [1.0] * 5), (None, [2.0] * 5), (7, [0.1] * 5), (7, [0.1] * 5)]
    out += [(1000, None), (1001, []), (1002, [1.0] * 4), (1003, [1.0, None, 1.0, 1.0, 1.0]), (1004, [math.nan] * 5), (1005, [math.inf] * 5)]
    return out


def test_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumns({"cluster": F.lit("x"), "vector": F.lit("y")})
    for k, rounds in ((8, 10), (3, 1), (1, 2), (600, 1)):
        assert got(clusters(df, k, rounds, 5)) == brute(rows, k, rounds, 5)


def test_huge_components_are_exact(spark, rows):
    big = [*rows[:60], (2000, [1e30, -1e30, 3.0, 0.0, 1.0]), (2001, [1e30, -1e30, 4.0, 0.0, 1.0]), (2002, [3e37] * 5), (2003, [4e4] * 5)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    assert got(clusters(df, 5, 4, 5)) == brute(big, 5, 4, 5)


def test_nothing(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert clusters(df).collect() == [] and clusters(df.filter("1 = 0")).collect() == []
    assert clusters(df).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


def test_bounds_save_distances(rows):
    at = np.array([[math.floor(x * 1024) for x in v] for _, v in rows[:400]], np.float64)
    fixed = centroids._spread_out([[int(x) for x in v] for v in at[:64]], 4)
    centre = [[int(x) for x in v] for v in at[64:80]]
    cached = np.stack([roots(squares(at, p)) for p in fixed], axis=1)
    which, best, computed = Ptolemy(fixed, centre).nearest(at, cached)
    want = [min((apart(map(int, v), c), i) for i, c in enumerate(centre)) for v in at.tolist()]
    assert list(zip(best.tolist(), which.tolist(), strict=True)) == want
    assert computed < 0.6 * at.shape[0] * len(centre)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(10**6), 10**6), min_size=3, max_size=3), min_size=6, max_size=20))
def test_no_bound_is_above_its_distance(points):
    at = np.array(points, np.float64)
    cached = np.stack([roots(squares(at, p)) for p in points[:3]], axis=1)
    bounds = Ptolemy(points[:3], points).bounds(cached)
    assert all(bounds[i, j] ** 2 <= apart(a, b) for i, a in enumerate(points) for j, b in enumerate(points))
