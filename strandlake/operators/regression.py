"""Regressions from sums: the rows stay where they are, the driver gets one row of cross products."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _table(df: DataFrame, names: Sequence[str], beta: np.ndarray, covariance: np.ndarray) -> DataFrame:
    made = []
    for name, b, v in zip(names, beta, np.diag(covariance), strict=True):
        se = math.sqrt(v) if v > 0 else None
        made.append((name, float(b), se, float(b) / se if se else None, _normal_p(float(b) / se) if se else None))
    return df.sparkSession.createDataFrame(made, "term string, estimate double, se double, z double, p double")


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "term string, estimate double, se double, z double, p double")


def _inputs(df: DataFrame, y: str, x: Sequence[str], *more: str) -> tuple[DataFrame, list[str]]:
    cols = [F.col(c).cast("double").alias(f"x{i + 1}") for i, c in enumerate(x)]
    rows = df.select(F.lit(1.0).alias("x0"), *cols, F.col(y).cast("double").alias("y"), *more)
    return rows.dropna(subset=[f"x{i + 1}" for i in range(len(x))] + ["y", *more]), ["x0", *(f"x{i + 1}" for i in range(len(x)))]


def _solve(a: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(a)


def ols_clustered(df: DataFrame, y: str, x: Sequence[str], cluster: str) -> DataFrame:
    """(term, estimate, se, z, p): least squares with an intercept, covariance robust to clusters.

    Rows with a null go. The factor for small samples is G/(G-1) * (N-1)/(N-K); p is the normal one. No rows, or one
    cluster: no terms. One shuffle, of a row of cross products for each cluster.
    """
    rows, names = _inputs(df, y, x, cluster)
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"a{i}_{j}") for i, j in pairs] + [F.sum(F.col(c) * F.col("y")).alias(f"b{i}") for i, c in enumerate(names)]
    by = rows.groupBy(cluster).agg(F.count("*").alias("n"), *sums)
    total = by.agg(F.sum("n").alias("n"), F.count("*").alias("g"), *(F.sum(c).alias(c) for c in by.columns if c not in (cluster, "n"))).first()
    if not total["n"] or total["g"] < 2 or total["n"] <= k:
        return _empty(df)
    a = np.array([[total[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    bread = _solve(a)
    beta = bread @ np.array([total[f"b{i}"] for i in range(k)])
    s = [F.col(f"b{i}") - sum((F.col(f"a{min(i, j)}_{max(i, j)}") * float(beta[j]) for j in range(1, k)), F.col(f"a0_{i}") * float(beta[0])) for i in range(k)]
    scores = by.select(*(c.alias(f"s{i}") for i, c in enumerate(s)))
    m = scores.agg(*(F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in pairs)).first()
    meat = np.array([[m[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    factor = total["g"] / (total["g"] - 1) * (total["n"] - 1) / (total["n"] - k)
    return _table(df, ["intercept", *x], beta, factor * bread @ meat @ bread)


def logit(df: DataFrame, y: str, x: Sequence[str], rounds: int = 25) -> DataFrame:
    """(term, estimate, se, z, p): logistic regression with an intercept by Newton's steps, Wald's p.

    Rows with a null go. Each step is one aggregate without a shuffle of rows. Where labels can be told apart without
    error, estimates grow until the last round. No rows, or one label alone: no terms.
    """
    rows, names = _inputs(df, y, x)
    k = len(names)
    size = rows.agg(F.count("*").alias("n"), F.sum("y").alias("s"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(names)), *(F.stddev_pop(c).alias(f"d{i}") for i, c in enumerate(names))).first()
    if not size["n"] or size["s"] in (0, size["n"]):
        return _empty(df)
    # Steps are taken in standard units and turned back at the end.
    mean = np.array([0.0, *(size[f"m{i}"] for i in range(1, k))])
    scale = np.array([1.0, *(size[f"d{i}"] or 1.0 for i in range(1, k))])
    z = [(F.col(c) - float(mean[i])) / float(scale[i]) for i, c in enumerate(names)]
    beta = np.zeros(k)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-sum((c * float(b) for c, b in zip(z[1:], beta[1:], strict=True)), F.lit(float(beta[0])))))
        step = rows.select("y", p.alias("p"), *(c.alias(f"z{i}") for i, c in enumerate(z)))
        weight = F.col("p") * (1 - F.col("p"))
        r = step.agg(*(F.sum(weight * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{i}_{j}") for i, j in pairs), *(F.sum(F.col(f"z{i}") * (F.col("y") - F.col("p"))).alias(f"g{i}") for i in range(k))).first()
        inverse = _solve(np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]))
        move = inverse @ np.array([r[f"g{i}"] for i in range(k)])
        beta = beta + move
        if np.abs(move).max() < 1e-9:
            break
    back = np.diag(1 / scale)
    back[0, 1:] = -mean[1:] / scale[1:]
    return _table(df, ["intercept", *x], back @ beta, back @ inverse @ back.T)
