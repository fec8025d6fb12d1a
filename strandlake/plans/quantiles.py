"""Queries of exact quantiles; DuckDB's percentile_cont is their oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.quantiles import exact
from strandlake.plans import sql
from strandlake.plans.base import table


def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = exact(spark, table(spark, sf_dir, "events"), ["event_type"], "value", {"q25": 0.25, "q50": 0.5, "q975": 0.975})
    return made.select("event_type", *(F.round(c, 9).alias(c) for c in ("q25", "q50", "q975")))


def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values are in each fifth."""
    cuts = ["a", "b", "c", "d"]
    events = table(spark, sf_dir, "events").select("value")
    q = exact(spark, events, [], "value", {c: (i + 1) / 5 for i, c in enumerate(cuts)}).select(*cuts)
    above = sum(((F.when(F.col("value") >= F.col(c), 1).otherwise(0)) for c in cuts), F.lit(0))
    return events.crossJoin(F.broadcast(q)).groupBy(above.alias("bin")).agg(F.count("*").alias("n"))


def box_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles, the outermost values within one and a half of their distance, and how many are beyond."""
    events = table(spark, sf_dir, "events").select("event_type", "value")
    q = exact(spark, events, ["event_type"], "value", {"a": 0.25, "b": 0.5, "c": 0.75})
    low, high = F.col("a") - 1.5 * (F.col("c") - F.col("a")), F.col("c") + 1.5 * (F.col("c") - F.col("a"))
    made = events.join(q, "event_type").groupBy("event_type", "a", "b", "c").agg(F.min(F.when(F.col("value") >= low, F.col("value"))).alias("low"), F.max(F.when(F.col("value") <= high, F.col("value"))).alias("high"), F.count_if((F.col("value") < low) | (F.col("value") > high)).alias("outside"))
    return made.select("event_type", F.round("a", 6).alias("q1"), F.round("b", 6).alias("middle"), F.round("c", 6).alias("q3"), "low", "high", "outside")


def per_scale_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mark: entities, those above expectation, the ratio of means, and the median effect."""
    eff = sql.spark_query("WITH " + sql._FRACTIONS + " SELECT mark, obs, nul, obs - nul AS effect FROM eff")(spark, sf_dir)
    means = eff.groupBy("mark").agg(F.count("*").alias("n"), F.count_if(F.col("effect") > 0).alias("positive"), F.round(F.try_divide(F.avg("obs"), F.avg("nul")), 9).alias("group_fold"))
    middle = exact(spark, eff, ["mark"], "effect", {"m": 0.5}).select("mark", F.round("m", 9).alias("median_effect"))
    return means.join(middle, "mark")


BY_BUFFER = (quantiles, quantile_bins, box_summary, per_scale_breadth)
