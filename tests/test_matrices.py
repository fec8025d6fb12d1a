"""Matrices against plain sums and ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import matrices


def test_windows(spark):
    rows = [(1, "abcde", 1), (2, "abcde", 3), (3, "abcde", 5), (4, "abcde", 6), (5, "abcde", 0), (6, None, 1), (7, "a", 1), (8, "", 1)]
    got = matrices.windows(spark.createDataFrame(rows, "k long, t string, p long"), "t", "p", 3)
    assert {r["k"]: r["peptide"] for r in got.collect()} == {1: "___ABCD", 2: "_ABCDE_", 3: "BCDE___", 7: "___A___"}


def test_scores_and_percentiles(spark):
    r = np.random.default_rng(3)
    weights = [(m, o, c, float(r.integers(-8, 9)) / 4) for m in ("m1", "m2", "m3") for o in (-2, -1, 0, 1) for c in "ABC"] + [("m1", 9, "A", 5.0), ("m2", 0, "é", 5.0), (None, 0, "A", 5.0), ("m2", 0, "A", None)]
    peptides = [(i, "".join(r.choice(list("ABCé_"), 5))) for i in range(60)] + [(100, None), (101, "ABC"), (None, "ABCAB")]
    table = spark.createDataFrame(weights, "matrix string, offset int, letter string, weight double")
    got = {(x["k"], x["matrix"]): x["score"] for x in matrices.scores(spark.createDataFrame(peptides, "k long, peptide string").withColumn("score", F.lit("x")), ["k"], table, 2).collect()}
    want = {(k, m): float(sum(w for n, o, c, w in weights if n == m and w is not None and abs(o) <= 2 and c.isascii() and p[o + 2] == c)) for k, p in peptides if p and len(p) == 5 for m in ("m1", "m2", "m3")}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    rows = [(-1 if k is None else k, m, v) for (k, m), v in want.items()]
    scored, reference = (spark.createDataFrame(x, "k long, matrix string, score double") for x in (rows, [x for x in rows if x[1] != "m3" and x[0] % 3]))
    made = {(x["k"], x["matrix"]): x["percentile"] for x in matrices.percentiles(scored, reference).collect()}
    for k, m, v in rows:
        own = [s for j, n, s in rows if n == m and n != "m3" and j % 3]
        assert made[k, m] == (pytest.approx(100 * float(np.mean([s <= v for s in own]))) if own else None)


def test_pairs_and_empty(spark):
    kind = "k long, matrix string, percentile double"
    case = spark.createDataFrame([(1, "a", 95.0), (1, "b", 20.0), (2, "a", 91.0), (3, "a", 99.0), (4, "a", None)], kind)
    control = spark.createDataFrame([(1, "a", 50.0), (1, "b", 92.0), (2, "a", 91.0), (4, "a", 1.0)], kind)
    by_pair, by_matrix = matrices.pairs(case, control, ["k"])
    assert sorted(map(tuple, by_pair.collect())) == [(1, 1, 1, 95.0, 92.0), (2, 1, 1, 91.0, 91.0)]
    assert sorted(map(tuple, by_matrix.collect())) == [("a", 2, 93.0, 70.5, 22.5), ("b", 1, 20.0, 92.0, -72.0)]
    none = spark.createDataFrame([], "k long, peptide string")
    weights = spark.createDataFrame([], "matrix string, offset int, letter string, weight double")
    assert matrices.scores(none, ["k"], weights, 2).collect() == []
    assert matrices.scores(spark.createDataFrame([(1, "ABCAB")], "k long, peptide string"), ["k"], weights, 2).collect() == []


@pytest.mark.parametrize("most", [0, 1000])
def test_one_row_a_text(spark, most):
    """cut(), ranked(), by_pair() and by_matrix() give what rows for each site and matrix give."""
    r = np.random.default_rng(5)
    texts = [(e, "".join(r.choice(list("ABCé"), 30 + e))) for e in range(12)] + [(50, None), (51, ""), (None, "ABCABC")]
    spots = [(e, int(p), bool(r.integers(0, 2))) for e in [*range(12), 50, 51, 60] for p in r.choice(45, 20, replace=False)] + [(None, 1, True)]
    weights = spark.createDataFrame([(m, o, c, float(r.integers(-8, 9)) / 4) for m in ("m1", "m2") for o in (-2, -1, 0, 1) for c in "ABC_"], "matrix string, offset int, letter string, weight double")
    of_text, sites = spark.createDataFrame(texts, "entity long, s string"), spark.createDataFrame(spots, "entity long, pos long, focal boolean")
    found = matrices.cut(of_text, sites.repartition(3), 2, 6)
    steps = matrices.ranked(found, weights, 2)
    joined = sites.join(of_text, "entity")
    sides = [matrices.scores(matrices.windows(joined.withColumn("at", F.col("pos") + on), "s", "at", 2), ["entity", "pos", "focal"], weights, 2) for on in (0, 6)]
    want_pair, want_matrix = matrices.pairs(*(matrices.percentiles(s.where("focal"), sides[0]) for s in sides), ["entity", "pos"])
    want = sorted(map(tuple, want_pair.collect()))
    assert sorted(map(tuple, matrices.by_pair(found, steps, weights, 2, most=most).collect())) == want and len(want) > 50
    assert [pytest.approx(tuple(x)[1:]) for x in want_matrix.orderBy("matrix").collect()] == [tuple(x)[1:] for x in matrices.by_matrix(steps).orderBy("matrix").collect()]
    # One row a text reaches the join, not one a site.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and matrices.cut(of_text.limit(0), sites, 2, 6).collect() == []
