"""Matrices over the documents' letters: nations are matrices by a rule, regions their families; events' positions are sites, and the controls are forty letters on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import matrices
from strandlake.plans import evolution
from strandlake.plans.base import hours, table
from strandlake.sources import files

_REACH, _ON = 5, 40
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(matrix, family, offset, letter, weight): quarters from -2 to 2."""
    named = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cells = named.select("n_nationkey", F.col("n_name").alias("matrix"), F.col("r_name").alias("family"), F.explode(F.sequence(F.lit(-_REACH), F.lit(_REACH))).alias("offset")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(25))))
    weight = (F.pmod(F.col("n_nationkey") * 31 + (F.col("offset") + _REACH) * 7 + F.col("k") * 13, F.lit(17)) - 8) / 4
    return cells.select("matrix", "family", "offset", F.substr(F.lit(_LETTERS), (F.col("k") + 1).cast("int"), F.lit(1)).alias("letter"), weight.alias("weight"))


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peptides of events' sites and of their controls."""
    spots = hours(table(spark, sf_dir, "events")).select("entity", (F.col("pos") + 1).alias("pos"), (F.col("mark") == "purchase").alias("focal")).groupBy("entity", "pos").agg(F.max("focal").alias("focal"))
    return matrices.cut(evolution.letters(table(spark, sf_dir, "documents")), spots, _REACH, _ON)


def matrix_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each site and its control: matrices over the 90th percentile, and the largest percentile."""
    found, weights = files.saved(spark, _cut(spark, sf_dir), "peptides"), _table(spark, sf_dir)
    made = matrices.by_pair(found, matrices.ranked(found, weights, _REACH), weights, _REACH)
    return made.withColumns({c: F.round(c, 9) for c in ("case_max", "control_max")})


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = _table(spark, sf_dir)
    made = matrices.by_matrix(matrices.ranked(_cut(spark, sf_dir), weights, _REACH))
    return made.join(weights.select("matrix", "family").distinct(), "matrix")


def matrix_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each matrix the mean percentiles of sites and controls, and their difference."""
    return _means(spark, sf_dir).select("matrix", "family", "n_pairs", *(F.round(c, 9).alias(c) for c in ("case_mean", "control_mean", "delta")))


def matrix_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n_matrices"), F.round(F.avg("delta"), 9).alias("delta"), F.round(F.min("delta"), 9).alias("least"), F.round(F.max("delta"), 9).alias("most"))


_SQL = f"""WITH {evolution._SEQS},
spot AS (SELECT user_id AS entity, CAST(floor((floor(epoch(ts)) - 1704067200) / 3600) AS BIGINT) + 1 AS pos, bool_or(event_type = 'purchase') AS focal FROM events GROUP BY ALL),
side AS (SELECT entity, pos, focal, g, pos + g AS spot FROM spot JOIN seqs ON doc_id = entity CROSS JOIN (SELECT unnest([0, {_ON}]) AS g) WHERE pos + g <= length(s)),
matrix AS (SELECT n_nationkey AS k, n_name AS matrix, r_name AS family FROM nation JOIN region ON n_regionkey = r_regionkey),
score AS (SELECT d.entity, d.pos, d.focal, d.g, m.matrix, sum(((m.k * 31 + (c.p - d.spot + {_REACH}) * 7 + (ascii(c.c) - 65) * 13) % 17 - 8) / 4) AS score FROM side d JOIN chars c ON c.doc_id = d.entity AND c.p BETWEEN d.spot - {_REACH} AND d.spot + {_REACH} CROSS JOIN matrix m GROUP BY ALL),
ref AS (SELECT matrix, list(score ORDER BY score) AS all_ FROM score WHERE g = 0 GROUP BY matrix),
pc AS (SELECT s.*, 100.0 * len(list_filter(all_, lambda x: x <= score)) / len(all_) AS pc FROM (SELECT DISTINCT matrix, score FROM score WHERE focal) s JOIN ref USING (matrix)),
both_ AS (SELECT a.entity, a.pos, a.matrix, p.pc AS a, q.pc AS b FROM score a JOIN score b ON a.entity = b.entity AND a.pos = b.pos AND a.matrix = b.matrix AND a.g = 0 AND b.g = {_ON} AND a.focal JOIN pc p ON p.matrix = a.matrix AND p.score = a.score JOIN pc q ON q.matrix = b.matrix AND q.score = b.score),
mean AS (SELECT matrix, family, count(*) AS n_pairs, avg(a) AS case_mean, avg(b) AS control_mean, avg(a) - avg(b) AS delta FROM both_ JOIN matrix USING (matrix) GROUP BY matrix, family)
"""

QUERIES = {
    matrix_sites: _SQL + "SELECT entity, pos, count(*) FILTER (WHERE a > 90) AS case_high, count(*) FILTER (WHERE b > 90) AS control_high, round(max(a), 9) AS case_max, round(max(b), 9) AS control_max FROM both_ GROUP BY entity, pos",
    matrix_means: _SQL + "SELECT matrix, family, n_pairs, round(case_mean, 9) AS case_mean, round(control_mean, 9) AS control_mean, round(delta, 9) AS delta FROM mean",
    matrix_families: _SQL + "SELECT family, count(*) AS n_matrices, round(avg(delta), 9) AS delta, round(min(delta), 9) AS least, round(max(delta), 9) AS most FROM mean GROUP BY family",
}
