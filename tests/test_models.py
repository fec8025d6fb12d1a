"""Regressions, redraws and matchings against plain versions."""

import itertools
import math

import numpy as np
import pytest

from strandlake.operators import matching, regression, resampling
from strandlake.plans import models


def test_hypergeometric_golden():
    assert resampling.hypergeometric_tail(8, 3535, 477, 10) == pytest.approx(3.655e-06, rel=1e-3)
    assert resampling.hypergeometric_tail(0, 10, 4, 3) == 1


def rows(n=300):
    r = np.random.default_rng(3)
    x = r.normal(size=(n, 2))
    g = r.integers(0, 20, n)
    y = 1 + x @ [2, -1] + r.normal(size=20)[g] + r.normal(size=n)
    return x, g, y


def test_ols_clustered(spark):
    x, g, y = rows()
    df = spark.createDataFrame([(float(a), float(b), int(k), float(v)) for (a, b), k, v in zip(x, g, y)] + [(None, 1.0, 1, 1.0)], "a double, b double, k long, y double")
    got = {r["term"]: r for r in regression.ols_clustered(df, "y", ["a", "b"], "k").collect()}
    z = np.column_stack([np.ones(len(y)), x])
    bread = np.linalg.inv(z.T @ z)
    beta = bread @ z.T @ y
    e = y - z @ beta
    s = np.array([(z[g == k] * e[g == k, None]).sum(0) for k in np.unique(g)])
    n_g = len(s)
    v = n_g / (n_g - 1) * (len(y) - 1) / (len(y) - 3) * bread @ (s.T @ s) @ bread
    for i, t in enumerate(["intercept", "a", "b"]):
        assert got[t]["estimate"] == pytest.approx(beta[i]) and got[t]["se"] == pytest.approx(math.sqrt(v[i, i]))
    assert regression.ols_clustered(df.limit(0), "y", ["a", "b"], "k").count() == 0


def test_logit(spark):
    x, _, y = rows()
    label = (y > 1).astype(int)
    df = spark.createDataFrame([(float(a) * 100 + 50, float(b), int(v)) for (a, b), v in zip(x, label)], "a double, b double, y int")
    got = {r["term"]: r["estimate"] for r in regression.logit(df, "y", ["a", "b"]).collect()}
    z = np.column_stack([np.ones(len(y)), x[:, 0] * 100 + 50, x[:, 1]])
    p = 1 / (1 + np.exp(-z @ [got["intercept"], got["a"], got["b"]]))
    assert np.abs(z.T @ (label - p)).max() < 1e-5  # the score is 0 at the maximum
    assert regression.logit(df.where("y = 1"), "y", ["a"]).count() == 0


def test_maximum_matching(spark):
    r = np.random.default_rng(5)
    edges = [(g, int(a), int(b)) for g in range(12) for a, b in r.integers(0, 5, (7, 2))]
    got = {x["g"]: x["matched"] for x in matching.maximum_matching(spark.createDataFrame(edges, "g long, a long, b long"), ["g"], "a", "b").collect()}
    for g in range(12):
        mine = {(a, b) for k, a, b in edges if k == g}
        best = max(n for n in range(6) for c in itertools.combinations(mine, n) if len({a for a, _ in c}) == n == len({b for _, b in c}))
        assert got[g] == best


def test_texts_are_counted_once(spark, tmp_path):
    """Features of odd texts are those of the plain definition, and what is made of texts is written, not made again for each pass."""
    texts = ["Ab cé\nDe W", "", None, "ÄÖ ß 日本\n\n", "aaaa QN fwy", "\x00 \t|P"]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(5)] + [(5, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    made = models.labelled(spark, str(tmp_path))
    got = {r["doc_id"]: r for r in made.collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and "documents.parquet" not in "".join(made.inputFiles())
    for i, r in got.items():
        t = texts[i]
        assert {k: r[k] for k in models._COMPOSITION} == {k: None if t is None else sum(c.isascii() and c.upper() in x for c in t) / max(len(t), 1) for k, x in models._COMPOSITION.items()}
        assert (r["words"], r["lines"]) == ((None, None) if t is None else (t.count(" "), t.count("\n")))
        assert r["log_length"] == (None if t is None else pytest.approx(np.log10(len(t) + 1))) and r["bundle"] == i // 8
