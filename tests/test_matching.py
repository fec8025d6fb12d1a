"""Matching over whole tables against going through the cases one by one."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import matching

KIND = "id long, rank long, x double, y double, w double"


def tie(i):
    return int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:15], 16)


def people(n, seed, whole=False):
    """Cases and donors; whole numbers make many equal distances and equal rows."""
    r = np.random.default_rng(seed)
    at = r.normal(0, 1, (n, 3)) if not whole else r.integers(0, 5, (n, 3)).astype(float)
    order = r.permutation(n)
    rows = [(i, int(order[i]), *map(float, at[i])) for i in range(n)]
    return rows[: n // 4], rows[n // 4 :]


def one_by_one(cases, donors, most, near, squares):
    free, got = {d[0]: d for d in donors}, []
    for c in sorted(cases, key=lambda c: c[1]):
        found = sorted((squares(c, d), tie(d[0]), d[0]) for d in free.values() if near(c, d))[:most]
        got += [(c[0], d, pytest.approx(q)) for q, _, d in found]
        for _, _, d in found:
            del free[d]
    return sorted(got, key=lambda x: x[:2])


def squares(c, d, dims=3):
    return sum((a - b) ** 2 for a, b in list(zip(c[2:], d[2:], strict=True))[:dims] if a is not None and b is not None)


@pytest.mark.parametrize(("n", "most", "whole"), [(2000, 3, False), (400, 1, True), (300, 3, True), (40, 5, False)])
def test_serve(spark, n, most, whole):
    cases, donors = people(n, n + most, whole)
    reach = 1.0 if whole else 0.5
    awkward = [(None, 1, 0.0, 0.0, 0.0), (90001, 2, None, 0.0, 0.0)]
    a, b = (spark.createDataFrame(x + awkward, KIND).repartition(3) for x in (cases, donors))
    pairs = matching.in_reach(a, b, ["x", "y"], reach, ["w"])
    got = matching.serve(spark, pairs, a.select(F.col("id").alias("case"), "rank"), most)
    box = lambda c, d: all(abs(p - q) <= reach for p, q in zip(c[2:], d[2:], strict=True))
    want = one_by_one(cases, donors, most, box, squares)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 5


@pytest.mark.parametrize(("n", "whole", "flip"), [(400, False, False), (300, True, False), (120, False, True)])
def test_greedy(spark, n, whole, flip):
    """flip: three times as many cases as donors, so that most find none."""
    cases, donors = people(n, n, whole)[:: -1 if flip else 1]
    cases = [(*c[:4], None if c[0] % 9 == 0 else c[4]) for c in cases]
    a, b = (spark.createDataFrame(x, KIND) for x in (cases, donors))
    got = matching.greedy_match(spark, a, b, ["x", "y"], ["w"])
    assert sorted(map(tuple, got.collect())) == one_by_one(cases, donors, 1, lambda c, d: True, squares)
    assert got.count() == min(len(cases), len(donors))


@pytest.mark.parametrize(("n", "most", "whole", "copies"), [(200, 3, True, 1), (40, 2, False, 6)])
def test_serve_near(spark, monkeypatch, n, most, whole, copies):
    """Leaves of 60 donors; copies share their covariates and follow each other."""
    monkeypatch.setattr(matching, "PART", 60)
    cases, donors = people(n, n + most, whole)
    cases, donors = ([(c[0] * copies + k, c[1] * copies + k, *c[2:]) for c in x for k in range(copies)] for x in (cases, donors))
    cases = [(*c[:4], None if c[0] % 9 == 0 else c[4]) for c in cases]
    reach = 1.0 if whole else 0.5
    a, b = (spark.createDataFrame(x + [(None, -1, 0.0, 0.0, 0.0), (90001, -2, None, 0.0, 0.0)], KIND).repartition(3) for x in (cases, donors))
    got = matching.serve_near(spark, a, b, ["x", "y"], ["w"], most, reach)
    box = lambda c, d: all(p is None or abs(p - q) <= reach for p, q in zip(c[2:], d[2:], strict=True))
    want = one_by_one(cases, donors, most, box, squares)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 5


def test_makes_no_pairs(spark, monkeypatch):
    """Hundreds of donors in reach of every case; no table of pairs is made."""
    cases, donors = people(2000, 1)
    monkeypatch.setattr(matching, "in_reach", None)
    a, b = (spark.createDataFrame(x, KIND) for x in (cases, donors))
    got = [r["case"] for r in matching.greedy_match(spark, a, b, ["x", "y"]).collect()]
    assert sorted(got) == sorted(c[0] for c in cases)


def test_empty(spark):
    none, some = spark.createDataFrame([], KIND), spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0)], KIND)
    for a, b in ((none, none), (some, none), (none, some)):
        assert matching.in_reach(a, b, ["x"], 0.5).collect() == [] == matching.greedy_match(spark, a, b, ["x", "y"]).collect()
        assert matching.serve(spark, matching.in_reach(a, b, ["x"], 0.5), a.select(F.col("id").alias("case"), "rank")).collect() == []


def test_standardised(spark):
    rows = spark.createDataFrame([(1, 9.0, 3.0), (2, 99.0, 3.0), (3, None, 3.0)], "id long, a double, b double")
    got = {r["id"]: (r["a"], r["b"]) for r in matching.standardised(rows, ["a", "b"], ["a"]).collect()}
    assert got == {1: (-1.0, 0.0), 2: (1.0, 0.0), 3: (None, 0.0)}


def test_groups_share_a_call(spark):
    """Many small groups are rows of a batch: none is a call of Python of its own."""
    r = np.random.default_rng(6)
    rows = [(int(g), int(a), int(b)) for g, a, b in zip(r.integers(0, 300, 3000), r.integers(0, 6, 3000), r.integers(0, 5, 3000), strict=True)] + [(None, 1, 1), (1, None, 1), (1, 1, None)]
    made = matching.maximum_matching(spark.createDataFrame(rows, "g long, a long, b long"), ["g"], "a", "b")
    near = {}
    for g, a, b in rows[:3000]:
        near.setdefault(g, {}).setdefault(a, set()).add(b)
    assert {x["g"]: x["matched"] for x in made.collect()} == {g: matching.matched({a: list(b) for a, b in own.items()}) for g, own in near.items()}
    assert "FlatMapGroups" not in made._jdf.queryExecution().optimizedPlan().toString()
