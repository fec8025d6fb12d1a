"""Islands: maximal chains of coordinates with small gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def chained(sites: DataFrame, keys: Sequence[str], pos: str, gap: int, min_sites: int) -> DataFrame:
    """Distinct sites with `island`, the number of their chain in its entity; chains of fewer than min_sites go.

    A chain breaks where the next coordinate is more than gap away. One shuffle by keys serves all windows.
    """
    order = W.partitionBy(*keys).orderBy(pos)
    far = F.coalesce(F.col(pos) - F.lag(pos).over(order) > gap, F.lit(True)).cast("int")
    marked = sites.select(*keys, pos).repartition(*keys).distinct().withColumn("_far", far).withColumn("island", F.sum("_far").over(order)).drop("_far")
    return marked.withColumn("_n", F.count("*").over(W.partitionBy(*keys, "island"))).where(F.col("_n") >= min_sites).drop("_n")


def islands(sites: DataFrame, keys: Sequence[str], pos: str, gap: int, min_sites: int) -> DataFrame:
    """(keys, start, end, valence) of each chain."""
    made = chained(sites, keys, pos, gap, min_sites)
    return made.groupBy(*keys, "island").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count("*").alias("valence")).drop("island")


def consensus(sites: DataFrame, keys: Sequence[str], pos: str, gaps: Sequence[int], final_gap: int, min_sites: int) -> DataFrame:
    """Sites that are in a chain at every gap, chained anew at final_gap. Chains at a smaller gap lie within those at a larger, so that the smallest gap alone decides."""
    core = chained(sites, keys, pos, min(gaps), min_sites).drop("island")
    return islands(core, keys, pos, final_gap, min_sites)
