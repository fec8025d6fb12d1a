"""Close pairs of coordinates and their exact null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions.stats import null_moments


def close_pairs(sites: DataFrame, keys: Sequence[str], pos: str, radius: int) -> DataFrame:
    """(keys, n, edges, adjacent): coordinates, pairs at most radius apart, and pairs of these that share one; by range frames, not a self-join."""
    near = W.partitionBy(*keys).orderBy(pos).rangeBetween(-radius, radius)
    degree = sites.select(*keys, pos).repartition(*keys).distinct().withColumn("d", F.count("*").over(near) - 1)
    half = lambda c: F.floor(F.sum(c) / 2).cast("long")
    return degree.groupBy(*keys).agg(F.count("*").alias("n"), half("d").alias("edges"), half(F.col("d") * (F.col("d") - 1)).alias("adjacent"))


def effects(sites: DataFrame, universe: DataFrame, entity: str, mark: str, pos: str, radius: int, min_sites: int = 3) -> DataFrame:
    """Per entity and mark: observed and expected fraction of close pairs, their difference, and its variance under the null."""
    seen = close_pairs(sites, [entity, mark], pos, radius).where(F.col("n") >= min_sites)
    all_ = close_pairs(universe, [entity], pos, radius).toDF(entity, "n_eligible", "eligible_edges", "eligible_adjacent")
    both = seen.join(all_, entity)
    mean, variance = null_moments(F.col("n_eligible"), F.col("n"), F.col("eligible_edges"), F.col("eligible_adjacent"))
    possible = F.col("n") * (F.col("n") - 1) / 2
    return both.select(entity, mark, F.lit(radius).alias("radius"), F.col("n").alias("n_sites"), "n_eligible", F.col("edges").alias("observed_pairs"), F.round(F.col("edges") / possible, 9).alias("observed"), F.round(mean / possible, 9).alias("expected"), F.round(F.col("edges") / possible - mean / possible, 9).alias("effect"), F.round(variance / (possible * possible), 9).alias("null_variance"))
