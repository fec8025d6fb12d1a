"""Guards on shards: each defect by itself and together."""

import os

import pytest
from pyspark.sql import functions as F

from strandlake.sources import guards
from strandlake.sources.guards import Guard

GUARD = Guard({"k": "bigint", "name": "string", "v": "double"}, ["k", "name"], ["v"], 2)
GOOD = [(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        (GOOD, []),
        ([*GOOD, (1, "a", 9.0), (1, "a", 9.0)], ["2 repeated k, name"]),
        ([*GOOD, (None, "x", 1.0), (3, None, 1.0), (4, " \t ", 1.0), (4, " \t ", 1.0)], ["1 blank k", "3 blank name"]),
        ([*GOOD, (5, "e", None), (6, "f", float("nan")), (5, "e", 1.0)], ["2 blank v", "1 repeated k, name"]),
        ([(1, "a", 1.0)], ["1 rows, not 2"]),
        ([], ["0 rows, not 2"]),
    ],
)
def test_write(spark, tmp_path, rows, want):
    path = f"{tmp_path}/shard"
    assert guards.write(spark, spark.createDataFrame(rows, "k long, name string, v double").repartition(3), path, GUARD) == want
    assert os.path.exists(path) == (not want)
    if not want:
        assert sorted(map(tuple, spark.read.parquet(path).collect())) == sorted(rows)


def test_schema(spark, tmp_path):
    df = spark.createDataFrame([("1", 2.0)], "k string, v double")
    assert guards.write(spark, df, f"{tmp_path}/s", GUARD) == ["no column name", "column k is string, not bigint"]
    assert not os.path.exists(f"{tmp_path}/s")
    assert guards.lacking(df, Guard({"k": ""}, ["z"])) == ["no column z"]


def test_coverage(spark):
    shards = spark.createDataFrame([(1,), (2,), (2,), (9,), (None,)], "k long")
    expected = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k long")
    assert tuple(guards.coverage(shards, expected, ["k"]).first()) == (1, 1, 1)
    assert tuple(guards.coverage(shards.limit(0), expected.limit(0), ["k"]).first()) == (0, 0, 0)
    assert tuple(guards.coverage(expected, expected.withColumn("_n", F.lit(1)), ["k"]).first()) == (0, 0, 0)
