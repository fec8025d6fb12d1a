"""Exact quantiles of any number of values: ranks within ranges of values, without a buffer of a group's values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.sources import files


def exact(spark: SparkSession, df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """(keys, n, one column for each name): quantiles of each group, between neighbouring values in proportion (0 is the least, 1 the largest).

    Equal values are counted before they are shuffled, distinct ones are dealt by ranges, so that a large group is in many tasks; a value's ranks are those
    in its range after what the ranges before hold. Nulls are left out; a group of nulls only has no row, NaN is above all. Without keys there is one row, of n = 0 and nulls for an empty table.
    """
    given = df.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), F.lit(0).alias("_one"), F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    group = [*(f"_{i}" for i in range(len(keys))), "_one"]
    counts = given.groupBy(*group, "_v").agg(F.count("*").alias("_n"))
    dealt = files.saved(spark, counts.repartitionByRange(*group, "_v").sortWithinPartitions(*group, "_v").withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33)), "ranges")
    of_part = W.partitionBy(*group, "_part").orderBy("_v")
    parts = dealt.groupBy(*group, "_part").agg(F.sum("_n").alias("_held"))
    of_group = W.partitionBy(*group)
    parts = parts.select(*group, "_part", (F.sum("_held").over(of_group.orderBy("_part")) - F.col("_held")).alias("_below"), F.sum("_held").over(of_group).alias("_size"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*group, "_part")]
    ranked = dealt.withColumn("_to", F.sum("_n").over(of_part)).alias("a").join(parts.alias("b"), same).select("a.*", "_below", "_size")
    last = F.col("_below") + F.col("_to")
    first = last - F.col("_n")
    at = {name: F.lit(float(p)) * (F.col("_size") - 1) for name, p in probabilities.items()}
    holds = lambda place: F.max(F.when((first <= place) & (place < last), F.col("_v")))
    ends = [x for name, h in at.items() for x in (holds(F.floor(h)).alias(f"{name}_low"), holds(F.ceil(h)).alias(f"{name}_high"), F.max(h - F.floor(h)).alias(f"{name}_share"))]
    found = ranked.groupBy(*group).agg(F.max("_size").alias("n"), *ends)
    made = found.select(*(F.col(f"_{i}").alias(k) for i, k in enumerate(keys)), "n", *((F.col(f"{x}_low") + F.when(F.col(f"{x}_share") == 0, 0.0).otherwise((F.col(f"{x}_high") - F.col(f"{x}_low")) * F.col(f"{x}_share"))).alias(x) for x in probabilities))
    if keys:
        return made
    return made.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *(F.max(x).alias(x) for x in probabilities))
