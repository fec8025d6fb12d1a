"""Geometric k-means against a plain version with Python's integers, over awkward tables; the geometry against sampled vectors."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import centroids

KIND = "vec_id long, embedding array<double>"


def plain(rows, k, dim, scale, rounds):
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    named = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centre = [v for _, v in named[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centre))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(centre)):
            if own := [v for (_, v), a in zip(kept, at, strict=True) if a == j]:
                centre[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr) if centre else [], centre


def table(n, dim, seed, spread=1.0):
    r = np.random.default_rng(seed)
    centre = r.normal(0, 3 * spread, (5, dim))
    rows = [(i, (centre[i % 5] + r.normal(0, spread, dim)).tolist()) for i in range(n)]
    rows += [(1000, [0.0] * dim)] * 40 + [(7, [1.0] * dim), (None, [2.0] * dim), (1001, None), (1002, []), (1003, [1.0] * (dim + 1)), (1004, [None] + [1.0] * (dim - 1)), (1005, [float("nan")] + [1.0] * (dim - 1)), (1006, [float("inf")] * dim), (1007, [-0.0] * dim)]
    return rows


@pytest.mark.parametrize(("n", "k", "dim", "rounds", "spread"), [(300, 16, 8, 3, 1.0), (200, 4, 3, 5, 1.0), (60, 6, 4, 2, 1e6), (2, 500, 4, 3, 1.0), (30, 3, 4, 0, 1.0)])
def test_plain(spark, n, k, dim, rounds, spread):
    rows = table(n, dim, n, spread)
    given = spark.createDataFrame(rows, KIND).withColumns({"cluster": F.lit("x"), "v": F.lit(1)}).repartition(5)
    got, centre, scanned = centroids.cluster(spark, given, k=k, dim=dim, scale=64, rounds=rounds)
    want, want_centre = plain(rows, k, dim, 64, rounds)
    assert centre == want_centre
    assert sorted(map(tuple, got.select("vec_id", "cluster", "distance").collect()), key=repr) == want
    assert len(scanned) == rounds + 1


def test_bounds_spare_scans(spark):
    rows = table(2000, 6, 1)
    _, _, scanned = centroids.cluster(spark, spark.createDataFrame(rows, KIND), k=5, dim=6, rounds=4)
    assert scanned[0] == 2043 and scanned[-1] < scanned[0] / 2


def test_empty(spark):
    for rows in ([], [(1, None)], [(2, [float("nan")] * 64)]):
        assert centroids.assigned(spark, spark.createDataFrame(rows, KIND)).collect() == []


def test_distances_beyond_a_long(spark):
    rows = [(i, [x] + [0.0] * 63) for i, x in enumerate([1e12, -1e12, 3.0])]
    got = {r["vec_id"]: r["distance"] for r in centroids.cluster(spark, spark.createDataFrame(rows, KIND), k=1, rounds=0)[0].collect()}
    assert sorted(got.values(), key=lambda x: x is not None)[:1] == [None] and 0 in got.values()


@pytest.mark.parametrize("seed", range(6))
def test_loosening_holds_and_is_below_the_drift(seed):
    """No vector of a sphere comes nearer to a moved centroid than its bound says, and most bounds are below the full drift."""
    r = np.random.default_rng(seed)
    dim, k = int(r.integers(2, 9)), 6
    old = r.normal(0, 10, (k, dim))
    new = old + r.normal(0, 2, (k, dim)) * r.integers(0, 2, (k, 1))
    radius = r.uniform(0.1, 12, k)
    bound, drift = centroids.loosening(old, new, radius), np.sqrt(((new - old) ** 2).sum(1))
    x = r.normal(size=(20_000, dim))
    x *= (r.uniform(0, 1, (len(x), 1)) ** (1 / dim)) / np.sqrt((x**2).sum(1, keepdims=True))
    x[:5000] /= np.sqrt((x[:5000] ** 2).sum(1, keepdims=True))  # on the surface, too
    for i in range(k):
        at = old[i] + radius[i] * x
        for j in range(k):
            lost = (np.sqrt(((at - old[j]) ** 2).sum(1)) - np.sqrt(((at - new[j]) ** 2).sum(1))).max()
            assert lost <= bound[i, j] + 1e-9
    assert (bound <= drift + 1e-12).all()
    if dim > 2:
        assert (bound < 0.95 * np.where(drift > 0, drift, np.inf)).mean() > 0.2
