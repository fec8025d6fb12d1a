"""Ranking metrics over scores, by windows within ranges of scores and offsets between these."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.sources import files


def cumulated(df: DataFrame, order: str, columns: Sequence[str], keys: Sequence[str] = (), down: bool = False) -> DataFrame:
    """df with, for each of columns, `column_before`: its sum over the key's rows that come before in order; rows of equal order are to be one row.

    Rows are dealt by ranges of key and order and written once. Within a range a window adds up; the sums of the ranges before it, one row a range and key, are added:
    no key's rows have to be in one task.
    """
    by = F.desc(order) if down else F.asc(order)
    part = F.shiftright(F.monotonically_increasing_id(), 33)
    rows = files.saved(df.sparkSession, df.repartitionByRange(*keys, by).sortWithinPartitions(*keys, by).withColumn("_range", part), "ranges")
    sums = rows.groupBy(*keys, "_range").agg(*(F.sum(c).alias(c) for c in columns))
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0.0)).alias(f"_{c}") for c in columns))
    inside = W.partitionBy(*keys, "_range").orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    both = rows.join(offsets, [*keys, "_range"])
    return both.select(*df.columns, *((F.col(f"_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0.0))).alias(f"{c}_before") for c in columns))


def auroc(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, positives, negatives, auroc): the rank-sum form, ties averaged; groups with one class go.

    Equal scores are counted first. Null keys and scores are left out.
    """
    steps = df.dropna(subset=[*keys, score]).groupBy(*keys, score).agg(F.sum(label).cast("double").alias("p"), F.sum(1 - F.col(label)).cast("double").alias("q"))
    won = cumulated(steps, score, ["q"], keys).withColumn("w", F.col("p") * (F.col("q_before") + F.col("q") / 2)).groupBy(*keys).agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.sum("w").alias("w"))
    return won.where("positives > 0 AND negatives > 0").select(*keys, F.col("positives").cast("long").alias("positives"), F.col("negatives").cast("long").alias("negatives"), F.round(F.col("w") / (F.col("positives") * F.col("negatives")), 9).alias("auroc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """(ap): the sum of precision times the step in recall, over distinct scores from the highest."""
    steps = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(label).cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    made = cumulated(steps, score, ["p", "n"], down=True)
    return made.agg(F.round(F.sum(F.col("p") * (F.col("p_before") + F.col("p")) / (F.col("n_before") + F.col("n"))) / F.sum("p"), 9).alias("ap"))


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, tpr, fpr) at each distinct score as threshold, from the highest."""
    steps = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(label).cast("double").alias("p"), F.sum(1 - F.col(label)).cast("double").alias("q"))
    total = steps.agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    made = cumulated(steps, score, ["p", "q"], down=True).crossJoin(F.broadcast(total))
    return made.select(score, *(F.round(F.try_divide(F.col(f"{c}_before") + F.col(c), F.col(f"_{c}")), 9).alias(n) for c, n in (("p", "tpr"), ("q", "fpr"))))
