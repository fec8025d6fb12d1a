"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm._store import save


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b): the smallest node that links reach.

    Alternating large-star and small-star steps (Kiveris et al., 2014), a logarithmic number of rounds in practice. Minima
    are taken by partial aggregation, and every round is written to the shared folder. Nodes without edges have no row.
    """
    now = save(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.greatest("b", "m").alias("x"), F.col("m").alias("y")).union(low.select("a", "m")).toDF("a", "b").where("a <> b").distinct()
        new = save(spark, small, "edges")
        # Done when every node has one smaller neighbour and none of these has a smaller one itself: then nothing moves any more.
        counts = new.agg(F.count("*").alias("n"), F.countDistinct("a").alias("k")).first()
        if counts["n"] == counts["k"] and new.join(new.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return new.toDF("node", "component").union(new.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        now = new


def roots(spark: SparkSession, parents: DataFrame) -> DataFrame:
    """(node, component): where the chain of parents (node, parent) ends, for each node. Chains have no circle.

    Each round doubles how far a row sees, and is written to the shared folder.
    """
    now = save(spark, parents.select("node", F.col("parent").alias("component"), F.lit(True).alias("open")), "roots")
    while not now.where("open").isEmpty():
        above = now.select(F.col("node").alias("component"), F.col("component").alias("next"))
        now = save(spark, now.join(above, "component", "left").select("node", F.coalesce("next", "component").alias("component"), F.col("next").isNotNull().alias("open")), "roots")
    return now.select("node", "component")
