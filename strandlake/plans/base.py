"""Views of the driver's tables in the model of entities, marks and coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds since 1970 of the first hour.
ORIGIN = 1704067200
MARKS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hours(events: DataFrame) -> DataFrame:
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return events.select(F.col("user_id").alias("entity"), F.col("event_type").alias("mark"), F.floor((seconds - ORIGIN) / 3600).cast("long").alias("pos"), "value", "event_id")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (entity, mark, pos)."""
    return hours(table(spark, sf_dir, "events")).select("entity", "mark", "pos").distinct()
