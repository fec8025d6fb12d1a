"""Redraws against plain loops over the same streams."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import draws

MASK = (1 << 64) - 1


def number(key, draw, seed=42):
    x = (int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:15], 16) + draw * 0x9E3779B97F4A7C15) & MASK
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def times(key, draw):
    u, k, p, cut = (number(key, draw) >> 11) / 2**53, 0, math.exp(-1), 0.0
    for i in range(10):
        cut += p
        k += u >= cut
        p /= i + 1
    return k


def quantiles(found):
    found = [x for x in found if x is not None]
    return [pytest.approx(q, abs=1e-9) for q in np.quantile(found, [0.025, 0.975])] if found else [None, None]


def ratio(rows, weight):
    a, b = sum(weight(k) * x for k, x, _ in rows), sum(weight(k) * y for k, _, y in rows)
    return a / b if b else None


@pytest.mark.parametrize("rows", [[(i % 9, float(i % 7), 1.0 + i % 3) for i in range(200)], [(1, 2.0, 4.0)], [(1, 2.0, 4.0)] * 3, [(1, 1.0, 0.0), (2, 3.0, 0.0)], [(i, 5.0, 1.0) for i in range(4)]])
def test_ratio(spark, rows):
    given = spark.createDataFrame([*rows, (None, 1.0, 1.0), (3, None, 1.0), (3, 1.0, None)], "k long, a double, b double").withColumns({"draw": F.lit(1), "base": F.lit(2), "n": F.lit("x")}).repartition(5)
    got = draws.ratio(given, "k", "a", "b", 200).first()
    want = ratio(rows, lambda k: 1)
    assert got["n"] == len({k for k, _, _ in rows}) and got["estimate"] == (want if want is None else pytest.approx(want))
    assert [got["ci_low"], got["ci_high"]] == quantiles([ratio(rows, lambda k, d=d: times(k, d)) for d in range(1, 201)])


def test_double_ratio_by_group(spark):
    r = np.random.default_rng(1)
    rows = [(i % 12, "xy"[i % 2], *map(float, r.uniform(1, 3, 4))) for i in range(90)]
    got = {x["g"]: x for x in draws.double_ratio(spark.createDataFrame(rows, "k long, g string, a double, b double, c double, d double"), "k", ("a", "b"), ("c", "d"), 100, by="g").collect()}
    for g in "xy":
        mine = [x for x in rows if x[1] == g]
        at = lambda w: (lambda s: s[0] / s[1] / (s[2] / s[3]) if all(s) else None)([sum(w(x[0]) * x[2 + j] for x in mine) for j in range(4)])  # noqa: E731, B023
        assert got[g]["estimate"] == pytest.approx(at(lambda k: 1)) and got[g]["n"] == 6
        assert [got[g]["ci_low"], got[g]["ci_high"]] == quantiles([at(lambda k, d=d: times(k, d)) for d in range(1, 101)])


def test_empty(spark):
    none = spark.createDataFrame([], "k long, v double, y int, b double")
    assert tuple(draws.mean(none, "k", "v", 20).first()) == (0, None, None, None)
    assert draws.ratio(none, "k", "v", "b", 20, by="y").collect() == []
    assert tuple(draws.sign_flip(none, "k", "v", 20).first()) == (0, None, 1.0)
    assert tuple(draws.auroc(none, "k", "y", "v", 20).first()) == (0, None, None, None)
    assert draws.stratified_null(none.withColumns({"s": F.lit("a"), "m": F.lit(True)}), "k", "y", "s", "m", draws=10).collect() == []


def test_equal_rows_of_other_keys_are_redrawn_by_themselves(spark):
    """400 rows of two values: the interval is that of 400 keys."""
    got = draws.mean(spark.createDataFrame([(i, float(i % 2)) for i in range(400)], "k long, v double"), "k", "v").first()
    assert got["estimate"] == 0.5 and 0.03 < got["ci_high"] - 0.5 < 0.07 and 0.03 < 0.5 - got["ci_low"] < 0.07


def test_sign_flip(spark):
    rows = [(i, ((i * 37) % 11 - 4) / 3) for i in range(20)]
    got = draws.sign_flip(spark.createDataFrame([*rows, (None, 1.0), (30, None)], "k long, v double"), "k", "v", 300).first()
    far = [abs(sum(v * (-1 if (number(k, d) >> 11) / 2**53 < 0.5 else 1) for k, v in rows)) for d in range(1, 301)]
    seen = abs(sum(v for _, v in rows))
    assert got["n"] == 20 and got["mean"] == pytest.approx(sum(v for _, v in rows) / 20)
    assert got["p"] == pytest.approx((1 + sum(x >= seen - 1e-9 for x in far)) / 301)
    even = spark.createDataFrame([(i, float((-1) ** i)) for i in range(20)], "k long, v double")
    assert draws.sign_flip(even, "k", "v", 200).first()["p"] == 1


def area(rows, weight):
    pos, neg = [(s, weight(k)) for k, y, s in rows if y], [(s, weight(k)) for k, y, s in rows if not y]
    total = sum(w for _, w in pos) * sum(w for _, w in neg)
    return sum(a * b * (1 if s > t else 0.5 if s == t else 0) for s, a in pos for t, b in neg) / total if total else None


@pytest.mark.parametrize("levels", [1, 3, 500])
def test_auroc(spark, levels):
    r = np.random.default_rng(levels)
    rows = [(int(k), int(y), float(s % levels)) for k, y, s in zip(r.integers(0, 15, 150), r.integers(0, 2, 150), r.integers(0, 1000, 150), strict=True)]
    got = draws.auroc(spark.createDataFrame(rows + [(1, None, 1.0), (2, 1, None)], "k long, y int, s double").repartition(6), "k", "y", "s", 60).first()
    assert got["n"] == 15 and got["estimate"] == pytest.approx(area(rows, lambda k: 1))
    assert [got["ci_low"], got["ci_high"]] == quantiles([area(rows, lambda k, d=d: times(k, d)) for d in range(1, 61)])


def test_one_kind_has_no_area(spark):
    assert draws.auroc(spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.6)], "k long, y int, s double"), "k", "y", "s", 30).first()["estimate"] is None


def test_draws_keep_the_counts_of_strata():
    positions, strata, own = np.array([1, 3, 5, 10, 12, 20]), np.array([0, 0, 0, 1, 1, 2]), np.array([True, True, False, True, False, True])
    there = draws.chosen(np.arange(6) * 977, strata, own, np.arange(1, 501))
    for s in range(3):
        assert (there[strata == s].sum(0) == own[strata == s].sum()).all()
    assert there[5].all() and 0.6 < there[0].mean() < 0.73 and 0.43 < there[3].mean() < 0.57
    assert len(np.unique(there, axis=1).T) == 6
    assert draws.close(np.array([1, 3, 10]), np.ones((3, 1), bool), (2, 7, 10))[:, 0].tolist() == [1, 2, 3]
    assert (draws.close(positions, there, (100,)) == 6).all()


@pytest.mark.parametrize("per_task", [7, 100])
def test_stratified_null(spark, per_task):
    r = np.random.default_rng(4)
    rows = [(e, int(p), "ABC"[p % 3] if e else "A", bool(r.integers(0, 3) == 0)) for e in range(5) for p in r.choice(90, 30, replace=False)]
    rows += [(9, 1, "A", True), (9, 2, "A", False), (8, 5, "B", True), (8, 6, "B", True), (None, 1, "A", True), (3, None, "A", True)]
    given = spark.createDataFrame([*rows, rows[0]], "e long, p long, s string, m boolean").repartition(4)
    got = {(x["e"], x["radius"]): x for x in draws.stratified_null(given, "e", "p", "s", "m", (4, 15), 150, per_task=per_task).collect()}
    assert {e for e, _ in got} == {0, 1, 2, 3, 4, 8}
    for e in (0, 1, 2, 3, 4, 8):
        pool = sorted((p, s, m) for k, p, s, m in rows if k == e and p is not None)
        count = Counter(s for _, s, m in pool if m)
        size = Counter(s for _, s, _ in pool)
        pairs = lambda at, radius: sum(abs(a - b) <= radius for i, a in enumerate(at) for b in at[:i])
        sampled = []
        for d in range(1, 151):
            at = []
            for s, k in count.items():
                at += sorted((number(f"{e}:{p}", d), p) for p, t, _ in pool if t == s)[:k]
            sampled.append([p for _, p in at])
        for radius in (4, 15):
            x, o = got[e, radius], pairs([p for p, _, m in pool if m], radius)
            null = np.array([pairs(at, radius) for at in sampled], float)
            n = sum(count.values())
            assert (x["n_sites"], x["n_strata"], x["observed_pairs"], x["possible_pairs"]) == (n, len(count), o, n * (n - 1) // 2)
            assert x["n_variable"] == sum(k for s, k in count.items() if k < size[s])
            assert x["null_mean"] == pytest.approx(null.mean() / x["possible_pairs"]) and x["null_sd"] == pytest.approx(null.std(ddof=1) / x["possible_pairs"], abs=1e-9)
            assert x["p"] == pytest.approx((1 + (null >= o).sum()) / 151)


@pytest.mark.parametrize("k", [1, 3, 29])
def test_chosen_have_the_smallest_numbers(k):
    start, numbers = np.arange(30) * 7919, np.arange(1, 301)
    want = draws.stream(start, numbers).argsort(0).argsort(0) < k
    assert (draws.chosen(start, np.zeros(30, int), np.arange(30) < k, numbers) == want).all()
    positions = np.cumsum(np.arange(30) % 4)
    assert draws.close(positions, want, (3, 9)).tolist() == [[sum(abs(positions[i] - positions[j]) <= r for i in np.flatnonzero(x) for j in np.flatnonzero(x) if i < j) for x in want.T] for r in (3, 9)]


def test_few_places_are_one_block(spark, monkeypatch):
    """All draws of an entity of few places are one block; where CELLS is small they are dealt by per_task, with the same result."""
    rows = spark.sql("SELECT e, transform(sequence(1, 9), x -> struct(x AS pos, x AS base, x AS stratum, true AS marked)) AS p FROM VALUES (1), (2) AS t(e)").withColumnRenamed("e", "entity")
    assert sorted(map(tuple, draws.dealt(rows, 150, 7).select("entity", "first", "width").collect())) == [(1, 0, 150), (2, 0, 150)]
    given = spark.createDataFrame([(e, p * p % 90, "AB"[p % 2], p % 3 == 0) for e in range(4) for p in range(9)], "e long, p long, s string, m boolean")
    made = [sorted(map(tuple, draws.stratified_null(given, "e", "p", "s", "m", (4, 15), 150, per_task=7).collect()))]
    monkeypatch.setattr(draws, "CELLS", 1)
    assert draws.dealt(rows, 150, 7).count() == 2 * 22
    made.append(sorted(map(tuple, draws.stratified_null(given, "e", "p", "s", "m", (4, 15), 150, per_task=7).collect())))
    assert made[0] == made[1] and len(made[0]) == 8
