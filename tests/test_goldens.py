"""Operators against published exact values on tiny inputs."""

import math

import pytest

from strandlake.functions.stats import null_moments, t_quantile, t_tail, wilson
from strandlake.operators import intervals, pairs, ranking


def sites(spark, positions, entity="P1"):
    return spark.createDataFrame([(entity, p) for p in positions], "entity string, pos long")


def chains(spark, positions, gap, least=3):
    made = intervals.islands(sites(spark, positions), ["entity"], "pos", gap, least)
    return sorted((r["start"], r["end"], r["valence"]) for r in made.collect())


def test_segmentation(spark):
    assert chains(spark, [1, 4, 9, 20, 22, 24], 5) == [(1, 9, 3), (20, 24, 3)]
    assert chains(spark, [24, 1, 4, 4, 9, 20, 22], 5) == [(1, 9, 3), (20, 24, 3)]
    assert chains(spark, [], 5) == []


def test_consensus(spark):
    made = lambda p, gaps, final: sorted((r["start"], r["end"], r["valence"]) for r in intervals.consensus(sites(spark, p), ["entity"], "pos", gaps, final, 3).collect())
    assert made([1, 4, 9, 20, 22, 24], (3, 5), 5) == [(20, 24, 3)]
    nested = [1, 4, 9, 17, 21, 25, 40, 47, 54]
    assert made(nested, (5, 8, 10, 12, 15), 5) == chains(spark, nested, 5)
    assert made([100, 103, 108, 116, 120, 124], (5,), 10) == [(100, 124, 6)]


def test_close_pairs(spark):
    got = lambda p, r: tuple(pairs.close_pairs(sites(spark, p), ["entity"], "pos", r).first())[2:]
    assert got([1, 3, 10], 2) == (1, 0) and got([1, 3, 10], 9) == (3, 3)
    assert [got([1, 3, 10], r)[0] for r in (2, 7, 10)] == [1, 2, 3]


def test_null_moments(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(3, 3, 1, 0), (4, 2, 2, 1)], "n int, k int, e int, a int")
    mean, variance = null_moments(*(F.col(c) for c in "nkea"))
    got = [tuple(r) for r in rows.orderBy("n").select(mean, variance).collect()]
    assert got[0] == pytest.approx((1, 0)) and got[1] == pytest.approx((1 / 3, 2 / 9))


def test_wilson(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(8, 10), (919, 1057), (0, 0)], "k int, n int")
    low, high = wilson(F.col("k"), F.col("n"))
    a, b, c = (tuple(r) for r in rows.select(low, high).collect())
    assert a[0] < 0.8 < a[1] and b == pytest.approx((0.8477857, 0.8884224), abs=1e-7) and c == (None, None)


def test_auroc_by_entity(spark):
    rows = [("P1", 1, 0.9, 0.1), ("P1", 0, 0.2, 0.8), ("P2", 1, 0.5, 0.5), ("P2", 1, 0.4, 0.4)]
    df = spark.createDataFrame(rows, "entity string, label int, up double, down double")
    for score, want in (("up", 1.0), ("down", 0.0)):
        assert [(r["entity"], r["auroc"]) for r in ranking.auroc(df, "label", score, ["entity"]).collect()] == [("P1", want)]


def test_t():
    assert t_tail(2.0, 10) == pytest.approx(0.03669401738537018) and t_quantile(0.975, 10) == pytest.approx(2.2281388519649385)
    assert t_tail(0.0, 5) == pytest.approx(0.5) and t_tail(-1.0, 3) == pytest.approx(1 - t_tail(1.0, 3)) and math.isclose(t_tail(40.0, 2), 0.000312, rel_tol=1e-2)
