"""Column expressions for exact sampling nulls, intervals and multiple testing."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: The standard normal's 0.975 quantile.
Z = 1.959963984540054


def wilson(successes: Column, total: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % Wilson interval; null for no trials."""
    n = F.when(total > 0, total.cast("double"))
    p = successes / n
    centre = (p + Z * Z / (2 * n)) / (1 + Z * Z / n)
    half = Z / (1 + Z * Z / n) * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    return centre - half, centre + half


def null_moments(n: Column, k: Column, edges: Column, adjacent: Column) -> tuple[Column, Column]:
    """Mean and variance of the close pairs among k of n coordinates drawn without replacement.

    edges: close pairs of all n; adjacent: pairs of these with a coordinate in common.
    """
    n, k, e, adjacent = (c.cast("double") for c in (n, k, edges, adjacent))

    def ratio(r: int) -> Column:
        num, den = F.lit(1.0), F.lit(1.0)
        for i in range(r):
            num, den = num * (k - i), den * (n - i)
        return F.coalesce(F.try_divide(num, den), F.lit(0.0))

    mean = e * ratio(2)
    disjoint = e * (e - 1) / 2 - adjacent
    second = mean + 2 * adjacent * ratio(3) + 2 * disjoint * ratio(4)
    return mean, F.greatest(second - mean * mean, F.lit(0.0))


def adjusted(df: DataFrame, p: str, key: str, family: list[str] | None = None) -> DataFrame:
    """df with holm (step-down) and bh (step-up) adjusted values of p within each family; ties by key."""
    part = [F.col(c) for c in family or []]
    up = W.partitionBy(*part).orderBy(p, key)
    m = F.count("*").over(W.partitionBy(*part))
    i = F.row_number().over(up)
    ranked = df.withColumns({"_i": i, "_m": m})
    running = up.rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(*part).orderBy(F.desc(p), F.desc(key)).rowsBetween(W.unboundedPreceding, 0)
    holm = F.least(F.max(F.col(p) * (F.col("_m") - F.col("_i") + 1)).over(running), F.lit(1.0))
    bh = F.least(F.min(F.col(p) * F.col("_m") / F.col("_i")).over(after), F.lit(1.0))
    return ranked.withColumns({"holm": holm, "bh": bh}).drop("_i", "_m")


def beta_fraction(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz's method)."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 1000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def t_tail(t: float, df: float) -> float:
    """P(T >= t) of Student's t."""
    half = beta_fraction(df / 2, 0.5, df / (df + t * t)) / 2
    return half if t >= 0 else 1 - half


def t_quantile(p: float, df: float) -> float:
    """The t whose upper tail is 1 - p, by bisection."""
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_tail(mid, df) > 1 - p else (low, mid)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def t_upper(t: pd.Series, df: pd.Series) -> pd.Series:
    """One-sided p of t; for a summary's few rows. Null where t is null or there are no degrees of freedom."""
    return pd.Series([t_tail(x, n) if x == x and n > 0 else None for x, n in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_critical(p: pd.Series, df: pd.Series) -> pd.Series:
    """The quantile p of Student's t; null without degrees of freedom."""
    return pd.Series([t_quantile(q, n) if n > 0 else None for q, n in zip(p, df, strict=True)], dtype="float64")


def t_summary(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, n, mean, se, t, ci_low, ci_high, p, log10_p): the mean, its 95 % interval and the one-sided test that it is over zero."""
    made = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("se"))
    made = made.withColumn("t", F.try_divide(F.col("mean"), F.col("se")))
    degrees, half = F.col("n") - 1, t_critical(F.lit(0.975), (F.col("n") - 1).cast("double")) * F.col("se")
    made = made.withColumn("p", t_upper("t", degrees.cast("double")))
    return made.select(*keys, "n", "mean", "se", "t", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"), "p", F.log10("p").alias("log10_p"))
