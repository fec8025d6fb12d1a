"""Exact quantiles against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators.quantiles import exact

ASKED = {"low": 0.0, "p": 0.31, "half": 0.5, "q": 0.975, "top": 1.0}


def test_groups(spark):
    r = np.random.default_rng(1)
    rows = [(int(g), float(np.round(v, k))) for k in (0, 1, 9) for g, v in zip(r.integers(0, 4, 500), r.normal(0, 3, 500), strict=True)]
    rows += [(9, 5.0)] * 700 + [(8, 1.0), (8, 2.0), (7, None), (None, 3.0), (None, 4.0)]
    given = spark.createDataFrame(rows, "g long, v double").withColumns({"_v": F.lit("x"), "n": F.lit(1)}).repartition(9)
    got = {x["g"]: x for x in exact(spark, given, ["g"], "v", ASKED).collect()}
    assert set(got) == {0, 1, 2, 3, 8, 9, None}
    for g, x in got.items():
        own = [v for k, v in rows if k == g and v is not None]
        assert x["n"] == len(own)
        assert [x[c] for c in ASKED] == [pytest.approx(np.quantile(own, p), abs=1e-12) for p in ASKED.values()]


def test_whole_table_and_empty(spark):
    given = spark.createDataFrame([(float(i % 10),) for i in range(1001)], "v double")
    assert exact(spark, given, [], "v", {"m": 0.5}).collect() == [(1001, 4.0)]
    assert exact(spark, given.limit(0), [], "v", {"m": 0.5}).collect() == [(0, None)]
    assert exact(spark, given.limit(0).withColumn("g", F.lit(1)), ["g"], "v", {"m": 0.5}).collect() == []
