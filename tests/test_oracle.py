"""Every query with SQL of its own gives the same rows in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from strandlake import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for r in rows:
        out.append(tuple(None if (v := r[i]) is None or isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v for i in order))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert normal(map(tuple, got.collect()), got.columns) == normal(want.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_controls_at_the_limit(spark, tmp_path):
    """control_windows: disorder of 0.25 beside ten times 0.1 is 0.15 apart; sums of doubles put the ten at 0.9999999999999999."""
    at = [(h, "purchase", 10.0) for h in range(10)] + [(24, "view", 25.0)]
    spark.createDataFrame([(i, 1, k, v, h * 3600 + 1704067200) for i, (h, k, v) in enumerate(at)], "event_id long, user_id long, event_type string, value double, t long").selectExpr("event_id", "timestamp_seconds(t) AS ts", "user_id", "event_type", "value").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1, "a" * 40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert list(map(tuple, catalog.queries()["control_windows"](spark, str(tmp_path)).collect())) == [(1, 1, 10, 21, 30, 1)]


def test_means_of_two(spark, tmp_path):
    """control_windows: the mean of 0.039 and 0.366 is a double just below 0.2025 in any order, and 0.15 from the region's, as in SQL; the exact one is further."""
    at = [(h, "purchase", 5.25) for h in range(3)] + [(9, "view", 3.9), (10, "view", 36.6)]
    spark.createDataFrame([(i, 1, k, v, h * 3600 + 1704067200) for i, (h, k, v) in enumerate(at)], "event_id long, user_id long, event_type string, value double, t long").selectExpr("event_id", "timestamp_seconds(t) AS ts", "user_id", "event_type", "value").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1, "a" * 12)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLES["control_windows"]).fetchall()
    assert list(map(tuple, catalog.queries()["control_windows"](spark, str(tmp_path)).collect())) == want and want[0][-1] == 3
