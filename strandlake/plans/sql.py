"""Queries written in SQL that Spark and DuckDB share. {hours} stands for the events as (entity, mark, pos, value, event_id)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.plans import alignments, controls, sequences
from strandlake.plans.base import ORIGIN, hours, table
from strandlake.sources import files

#: The events in DuckDB; Spark has them from base.hours.
DUCK_HOURS = f"(SELECT user_id AS entity, event_type AS mark, CAST(floor((floor(epoch(ts)) - {ORIGIN}) / 3600) AS BIGINT) AS pos, value, event_id FROM events)"

_SITES = "sites AS (SELECT DISTINCT entity, mark, pos FROM {hours} h)"
_CHAIN = _SITES + """, flagged AS (SELECT entity, mark, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY entity, mark ORDER BY pos) <= 24 THEN 0 ELSE 1 END AS f FROM sites),
numbered AS (SELECT entity, mark, pos, sum(f) OVER (PARTITION BY entity, mark ORDER BY pos) AS k FROM flagged),
islands AS (SELECT entity, mark, min(pos) AS s, max(pos) AS e, count(*) AS n FROM numbered GROUP BY entity, mark, k HAVING count(*) >= 3)"""
_FRACTIONS = _SITES + """, near AS (SELECT entity, mark, pos, count(*) OVER (PARTITION BY entity, mark ORDER BY pos RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) - 1 AS d FROM sites),
seen AS (SELECT entity, mark, count(*) AS n, sum(d) / 2e0 AS e FROM near GROUP BY entity, mark HAVING count(*) >= 3),
pool AS (SELECT DISTINCT entity, pos FROM sites),
near_pool AS (SELECT entity, pos, count(*) OVER (PARTITION BY entity ORDER BY pos RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) - 1 AS d FROM pool),
expected AS (SELECT entity, count(*) AS n_all, sum(d) / 2e0 AS e_all FROM near_pool GROUP BY entity),
eff AS (SELECT s.entity, s.mark, s.n, s.e / (s.n * (s.n - 1) / 2e0) AS obs, x.e_all / (x.n_all * (x.n_all - 1) / 2e0) AS nul FROM seen s JOIN expected x ON s.entity = x.entity)"""
# Ranks over all entities by buckets of the effect, which lies between -1 and 1: a window runs within a bucket, and offsets come from
# the few buckets' sums, so that no task gets all rows. o_below and x_below: sums over the entities of lower rank.
_DOWN = "OVER (PARTITION BY bucket ORDER BY obs - nul, entity DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_RANKED = _FRACTIONS + f""", bucketed AS (SELECT entity, obs, nul, CAST(floor((obs - nul) * 512e0) AS BIGINT) AS bucket FROM eff WHERE mark = 'purchase'),
buckets AS (SELECT bucket, count(*) AS n, sum(obs) AS o, sum(nul) AS x FROM bucketed GROUP BY bucket),
offsets AS (SELECT bucket, sum(n) OVER () AS total, coalesce(sum(n) OVER (ORDER BY bucket DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, coalesce(sum(o) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS o_lower, coalesce(sum(x) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS x_lower FROM buckets),
base AS (SELECT entity, obs, nul, obs - nul AS effect, CAST(above + row_number() OVER (PARTITION BY b.bucket ORDER BY obs - nul DESC, entity) AS BIGINT) AS r, CAST(total AS BIGINT) AS total, o_lower + coalesce(sum(obs) {_DOWN.replace('bucket', 'b.bucket')}, 0e0) AS o_below, x_lower + coalesce(sum(nul) {_DOWN.replace('bucket', 'b.bucket')}, 0e0) AS x_below FROM bucketed b JOIN offsets f ON b.bucket = f.bucket)"""
_SCORED = "scored AS (SELECT d.doc_id, d.lang, l.quality AS label, length(d.text) - length(replace(d.text, ' ', '')) AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL)"
#: Radii at which an entity has to be positive, each as (entity, mark, effect).
_RADII = (5, 10, 25)
_SCALES = _SITES + ", near AS (SELECT entity, mark" + "".join(f", count(*) OVER (PARTITION BY entity, mark ORDER BY pos RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) - 1 AS d{r}" for r in _RADII) + " FROM sites), seen AS (SELECT entity, mark, count(*) AS n" + "".join(f", sum(d{r}) / 2e0 AS e{r}" for r in _RADII) + " FROM near GROUP BY entity, mark HAVING count(*) >= 3), pool AS (SELECT DISTINCT entity, pos FROM sites), near_pool AS (SELECT entity" + "".join(f", count(*) OVER (PARTITION BY entity ORDER BY pos RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) - 1 AS d{r}" for r in _RADII) + " FROM pool), expected AS (SELECT entity, count(*) AS n_all" + "".join(f", sum(d{r}) / 2e0 AS x{r}" for r in _RADII) + " FROM near_pool GROUP BY entity), wide AS (SELECT s.entity, s.mark" + "".join(f", e{r} / (n * (n - 1) / 2e0) - x{r} / (n_all * (n_all - 1) / 2e0) AS f{r}" for r in _RADII) + " FROM seen s JOIN expected x ON s.entity = x.entity), scales AS (" + " UNION ALL ".join(f"SELECT entity, mark, f{r} AS effect FROM wide" for r in _RADII) + ")"

_UP, _BACK = (f"OVER (PARTITION BY entity ORDER BY place{d} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" for d in ("", " DESC"))
# Sites of some marks and, as an entity's islands lie apart in order, the end of the last focal island that begins up to the site and the start of the next one.
_NEAREST = f"""points AS (SELECT DISTINCT entity, mark, pos FROM sites), along AS (SELECT entity, mark, pos, pos AS place, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e FROM points UNION ALL SELECT entity, CAST(NULL AS VARCHAR(20)) AS mark, CAST(NULL AS BIGINT) AS pos, s AS place, s, e FROM islands WHERE mark = 'purchase'),
sides AS (SELECT entity, mark, pos, max(e) {_UP} AS e_before, min(s) {_BACK} AS s_after FROM along),
nearest AS (SELECT entity, mark, pos, CASE WHEN e_before IS NOT NULL OR s_after IS NOT NULL THEN greatest(least(coalesce(pos - e_before, s_after - pos), coalesce(s_after - pos, pos - e_before)), 0) END AS x FROM sides WHERE pos IS NOT NULL)"""
# Cases (v of their group g) beside the controls next below and above: sorted once, not compared with all.
_NEXT = """c AS (SELECT c_custkey AS k, c_nationkey AS g, {value} AS v, c_mktsegment = 'BUILDING' AS is_case FROM customer{more}), d AS (SELECT g, v, min(k) AS k, count(*) AS m FROM c WHERE NOT is_case GROUP BY g, v), u AS (SELECT g, v, k AS case_key, 0 AS m FROM c WHERE is_case UNION ALL SELECT g, v, CAST(NULL AS BIGINT) AS case_key, m FROM d), w AS (SELECT g, v, case_key, max(CASE WHEN case_key IS NULL THEN v END) OVER (PARTITION BY g ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo, min(CASE WHEN case_key IS NULL THEN v END) OVER (PARTITION BY g ORDER BY v DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi{count} FROM u)"""

SHARED: dict[str, str] = {
    "scan_project": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderstatus = 'F'",
    "filter_in": "SELECT mark, count(*) AS n, round(avg(value), 6) AS mean_value FROM {hours} h WHERE mark IN ('purchase', 'view') AND value >= 10 GROUP BY mark",
    "distinct_sites": "SELECT DISTINCT entity, mark, pos FROM {hours} h",
    "coerce_cast": "SELECT page_id, CAST(floor(x) AS BIGINT) AS number FROM (SELECT page_id, try_cast(last AS DOUBLE) AS x FROM (SELECT page_id, regexp_replace(url, '^.*/', '') AS last FROM pages) u) t WHERE x IS NOT NULL",
    "validate_sites": "WITH " + _SITES + " SELECT s.entity, s.mark, s.pos, substr(d.text, CAST(s.pos + 1 AS INTEGER), 1) AS symbol FROM sites s JOIN documents d ON d.doc_id = s.entity WHERE substr(d.text, CAST(s.pos + 1 AS INTEGER), 1) IN ('s', 't')",
    "validate_audit": "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN c.c_custkey IS NULL THEN 'missing' WHEN o.o_totalprice < 1000 THEN 'out_of_range' WHEN substr(c.c_mktsegment, 1, 1) <> 'B' THEN 'mismatch' ELSE 'ok' END AS reason FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey) t GROUP BY reason",
    "dup_key_check": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "median_matched_subset": "WITH m AS (SELECT median(n_chars) AS c, median(CAST(length(text) - length(replace(text, 't', '')) AS DOUBLE)) AS t FROM documents) SELECT doc_id FROM documents CROSS JOIN m WHERE n_chars >= c AND length(text) - length(replace(text, 't', '')) >= t",
    "informative_groups": "SELECT d.source, count(*) AS n, sum(l.quality) AS positives FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source HAVING count(DISTINCT l.quality) = 2",
    "min_sites": "WITH " + _SITES + " SELECT entity, mark, count(*) AS n FROM sites GROUP BY entity, mark HAVING count(*) >= 3",
    "join_lookup": "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey",
    "join_default": "SELECT d.doc_id, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "semi_flag": "SELECT c.c_custkey, o.k IS NOT NULL AS has_order FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000) o ON c.c_custkey = o.k",
    "anti_controls": "WITH " + _SITES + " SELECT DISTINCT a.entity, a.pos FROM sites a WHERE NOT EXISTS (SELECT 1 FROM sites b WHERE b.entity = a.entity AND b.pos = a.pos AND b.mark = 'purchase')",
    "setops": "WITH " + _SITES + " SELECT 'both' AS kind, count(*) AS n FROM (SELECT entity, pos FROM sites WHERE mark = 'purchase' INTERSECT SELECT entity, pos FROM sites WHERE mark = 'view') a UNION ALL SELECT 'only' AS kind, count(*) AS n FROM (SELECT entity, pos FROM sites WHERE mark = 'purchase' EXCEPT SELECT entity, pos FROM sites WHERE mark = 'view') b",
    "observed_union": "WITH " + _SITES + ", u AS (SELECT entity, count(DISTINCT pos) AS n_union, count(DISTINCT CASE WHEN mark = 'purchase' THEN pos END) AS n_a, count(DISTINCT CASE WHEN mark = 'view' THEN pos END) AS n_b FROM sites WHERE mark IN ('purchase', 'view') GROUP BY entity) SELECT entity, n_union, n_a, n_b FROM u WHERE n_a > 0 AND n_b > 0 AND n_union > n_a AND n_union > n_b",
    "matched_dominance": "WITH " + _FRACTIONS + " SELECT count(*) AS n, sum(CASE WHEN a.obs - a.nul > b.obs - b.nul THEN 1 ELSE 0 END) AS dominant FROM eff a JOIN eff b ON a.entity = b.entity WHERE a.mark = 'purchase' AND b.mark = 'view'",
    "per_scale_breadth": "WITH " + _FRACTIONS + " SELECT mark, count(*) AS n, sum(CASE WHEN obs - nul > 0 THEN 1 ELSE 0 END) AS positive, round(avg(obs) / avg(nul), 9) AS group_fold, round(median(obs - nul), 9) AS median_effect FROM eff GROUP BY mark",
    "group_fold": "WITH " + _FRACTIONS + " SELECT mark, round(avg(obs) / nullif(avg(nul), 0), 9) AS fold FROM eff GROUP BY mark",
    "pivot_effects": "WITH " + _FRACTIONS + " SELECT entity, round(max(CASE WHEN mark = 'purchase' THEN obs - nul END), 9) AS purchase, round(max(CASE WHEN mark = 'view' THEN obs - nul END), 9) AS viewed, round(max(CASE WHEN mark = 'click' THEN obs - nul END), 9) AS click FROM eff GROUP BY entity",
    "entity_fold_pairs": "WITH " + _FRACTIONS + " SELECT a.entity, round(a.obs / a.nul, 9) AS fold_a, round(b.obs / b.nul, 9) AS fold_b FROM eff a JOIN eff b ON a.entity = b.entity WHERE a.mark = 'purchase' AND b.mark = 'view' AND a.nul > 0 AND a.obs > 0 AND b.obs > 0",
    "rank_effects": "WITH " + _RANKED + " SELECT entity, r, total, round(effect, 9) AS effect FROM base",
    "adversarial_curve": "WITH " + _RANKED + ", cut AS (SELECT CAST(pct AS BIGINT) AS pct, CAST(floor(n * pct / 100e0) AS BIGINT) AS removed FROM (SELECT EACH((0, 80)) AS pct, n FROM (SELECT sum(n) AS n FROM buckets) t) g) SELECT pct, removed, total - removed AS left_n, round((o_below + obs) / (x_below + nul), 9) AS group_fold FROM cut JOIN base ON r = removed + 1",
    "single_step_curve": "WITH " + _RANKED + " SELECT r AS removed, CASE WHEN r < total THEN round(o_below / x_below, 9) END AS group_fold FROM base",
    "first_crossing": "WITH " + _RANKED + ", curve AS (SELECT r, CASE WHEN r < total THEN o_below / x_below END AS fold FROM base) SELECT min(r) FILTER (WHERE fold < 1) AS first_below, count(*) AS n FROM curve",
    "random_envelope": "WITH " + _RANKED + ", cut AS (SELECT CAST(pct AS BIGINT) AS pct, CAST(floor(n * pct / 100e0) AS BIGINT) AS removed FROM (SELECT EACH((0, 80)) AS pct, n FROM (SELECT sum(n) AS n FROM buckets) t) g), hashed AS (SELECT rep, entity, obs, nul, md5(concat(CAST(entity AS VARCHAR(20)), ':', CAST(rep AS VARCHAR(20)))) AS h FROM base CROSS JOIN (SELECT EACH((1, 500)) AS rep) g), shuffled AS (SELECT rep, entity, obs, nul, h, substr(h, 1, 2) AS b FROM hashed), parts AS (SELECT rep, b, count(*) AS n, sum(obs) AS o, sum(nul) AS x FROM shuffled GROUP BY rep, b), shifts AS (SELECT rep, b, coalesce(sum(n) OVER (PARTITION BY rep ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, coalesce(sum(o) OVER (PARTITION BY rep ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS o_after, coalesce(sum(x) OVER (PARTITION BY rep ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS x_after FROM parts), kept AS (SELECT s.rep, below + row_number() OVER (PARTITION BY s.rep, s.b ORDER BY h, entity) AS k, o_after + sum(obs) OVER w AS o, x_after + sum(nul) OVER w AS x FROM shuffled s JOIN shifts t ON t.rep = s.rep AND t.b = s.b WINDOW w AS (PARTITION BY s.rep, s.b ORDER BY h DESC, entity DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT pct, removed, count(*) AS n, round(percentile_cont(0.025) WITHIN GROUP (ORDER BY o / x), 9) AS lo, round(median(o / x), 9) AS mid, round(percentile_cont(0.975) WITHIN GROUP (ORDER BY o / x), 9) AS hi FROM cut JOIN kept ON k = removed + 1 GROUP BY pct, removed",
    "quantiles": "SELECT event_type, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY value), 9) AS q25, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 9) AS q50, round(percentile_cont(0.975) WITHIN GROUP (ORDER BY value), 9) AS q975 FROM events GROUP BY event_type",
    "dispersion": "SELECT event_type, round(stddev_samp(value), 6) AS sd1, round(stddev_pop(value), 6) AS sd0, round(var_samp(value), 4) AS v1 FROM events GROUP BY event_type",
    "multiscale": "WITH " + _SCALES + f" SELECT entity, mark, bool_and(effect > 0) AS positive_at_all, round(min(effect), 9) AS least FROM scales GROUP BY entity, mark HAVING count(effect) = {len(_RADII)}",
    "pair_counts_multi": "WITH " + _SITES + ", d AS (SELECT mark" + "".join(f", count(*) OVER (PARTITION BY entity, mark ORDER BY pos RANGE BETWEEN {r} PRECEDING AND CURRENT ROW) - 1 AS d{r}" for r in (2, 10, 50)) + " FROM sites) SELECT mark, CAST(sum(d2) AS BIGINT) AS r2, CAST(sum(d10) AS BIGINT) AS r10, CAST(sum(d50) AS BIGINT) AS r50 FROM d GROUP BY mark HAVING sum(d50) > 0",
    "set_metrics": "WITH " + _SITES + ", a AS (SELECT entity, pos FROM sites WHERE mark = 'purchase'), b AS (SELECT entity, pos FROM sites WHERE mark = 'view'), j AS (SELECT a.entity AS ea, b.entity AS eb FROM a FULL OUTER JOIN b ON a.entity = b.entity AND a.pos = b.pos) SELECT round(count(*) FILTER (WHERE ea IS NOT NULL AND eb IS NOT NULL) / (1e0 * count(*)), 9) AS jaccard, round(count(*) FILTER (WHERE ea IS NOT NULL AND eb IS NOT NULL) / (1e0 * count(ea)), 9) AS recall FROM j",
    "region_table": "WITH " + _CHAIN + " SELECT entity, mark, row_number() OVER (PARTITION BY entity, mark ORDER BY s) AS region_index, s AS region_start, e AS region_end, e - s + 1 AS span, n AS valence, concat(mark, ':', CAST(entity AS VARCHAR(20)), ':', CAST(s AS VARCHAR(20)), '-', CAST(e AS VARCHAR(20))) AS region_id FROM islands",
    "interval_overlap": "WITH " + _CHAIN + f", along AS (SELECT entity, e AS place, s, CAST(NULL AS BIGINT) AS other FROM islands WHERE mark = 'purchase' UNION ALL SELECT entity, s AS place, CAST(NULL AS BIGINT) AS s, e AS other FROM islands WHERE mark = 'view'), seen AS (SELECT s, max(other) {_UP} AS reached FROM along) SELECT count(*) AS n, sum(CASE WHEN reached >= s THEN 1 ELSE 0 END) AS touched FROM seen WHERE s IS NOT NULL",
    "tile_labels": "WITH " + _CHAIN + ", " + _NEAREST + " SELECT DISTINCT entity, pos, CASE WHEN x <= 15 THEN 1 ELSE 0 END AS label FROM nearest",
    "span_distance": "WITH " + _CHAIN + ", " + _NEAREST + " SELECT DISTINCT entity, pos, x AS distance FROM nearest WHERE x IS NOT NULL",
    "distance_profile": "WITH " + _CHAIN + ", " + _NEAREST + ", g AS (SELECT CAST(r AS BIGINT) AS radius FROM (SELECT EACH((0, 60)) AS r) e), f AS (SELECT radius, entity, mark, avg(CASE WHEN x <= radius THEN 1e0 ELSE 0e0 END) AS share FROM nearest CROSS JOIN g WHERE x IS NOT NULL AND mark IN ('view', 'click') GROUP BY radius, entity, mark) SELECT radius, mark, round(avg(share), 9) AS mean_share FROM f GROUP BY radius, mark",
    "sensitivity_grid": "WITH " + _SITES + ", params AS (SELECT CAST(g AS BIGINT) AS gap FROM (SELECT EACH((5, 48)) AS g) e WHERE g IN (5, 8, 10, 12, 15, 24, 48)), flagged AS (SELECT gap, entity, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY gap, entity ORDER BY pos) <= gap THEN 0 ELSE 1 END AS f FROM sites CROSS JOIN params WHERE mark = 'purchase'), numbered AS (SELECT gap, entity, sum(f) OVER (PARTITION BY gap, entity ORDER BY pos) AS k FROM flagged), isl AS (SELECT gap, entity, k, count(*) AS n FROM numbered GROUP BY gap, entity, k) SELECT gap, m AS min_sites, count(*) FILTER (WHERE n >= m) AS islands FROM isl CROSS JOIN (SELECT CAST(m AS BIGINT) AS m FROM (SELECT EACH((2, 4)) AS m) e) q GROUP BY gap, m",
    "loo_survival": "WITH " + _SITES + ", proof AS (SELECT DISTINCT entity, pos, CAST(floor(value / 50) AS BIGINT) AS src FROM {hours} h WHERE mark = 'purchase'), gone AS (SELECT DISTINCT entity, src AS removed FROM proof), kept AS (SELECT DISTINCT g.entity, g.removed, p.pos FROM gone g JOIN proof p ON p.entity = g.entity AND p.src <> g.removed), flagged AS (SELECT entity, removed, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY entity, removed ORDER BY pos) <= 24 THEN 0 ELSE 1 END AS f FROM kept), numbered AS (SELECT entity, removed, sum(f) OVER (PARTITION BY entity, removed ORDER BY pos) AS k FROM flagged), left_over AS (SELECT entity, removed, max(n) AS best FROM (SELECT entity, removed, k, count(*) AS n FROM numbered GROUP BY entity, removed, k) z GROUP BY entity, removed) SELECT g.entity, count(*) AS removals, sum(CASE WHEN l.best >= 3 THEN 1 ELSE 0 END) AS survived FROM gone g LEFT JOIN left_over l ON g.entity = l.entity AND g.removed = l.removed GROUP BY g.entity",
    "local_opportunity": "WITH " + _SITES + ", m AS (SELECT entity, pos, max(CASE WHEN mark = 'purchase' THEN 1 ELSE 0 END) AS focal, max(CASE WHEN mark = 'view' THEN 1 ELSE 0 END) AS other FROM sites GROUP BY entity, pos), w AS (SELECT entity, pos, focal, other, sum(CASE WHEN focal = 0 THEN other ELSE 0 END) OVER v AS hit, sum(1 - focal) OVER v AS controls FROM m WINDOW v AS (PARTITION BY entity ORDER BY pos RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING)) SELECT entity, pos, other AS observed, round(hit / (1e0 * nullif(controls, 0)), 9) AS expected, controls FROM w WHERE focal = 1",
    "nested_nulls": "WITH " + _SITES + ", m AS (SELECT entity, pos, max(CASE WHEN mark = 'purchase' THEN 1 ELSE 0 END) AS a, max(CASE WHEN mark = 'view' THEN 1 ELSE 0 END) AS b FROM sites GROUP BY entity, pos), z AS (SELECT entity, CAST(floor(pos / 144e0) AS BIGINT) AS bin, sum(a) AS p, sum(b) AS o, count(*) AS pool, sum(a * b) AS both_n FROM m GROUP BY entity, CAST(floor(pos / 144e0) AS BIGINT)) SELECT entity, sum(both_n) AS observed, round(sum(p) * sum(o) / 720e0, 9) AS expected_length, round(sum(p) * sum(o) / (1e0 * sum(pool)), 9) AS expected_pool, round(sum(p * o / (1e0 * pool)), 9) AS expected_bins FROM z GROUP BY entity",
    "nn_match": "WITH " + _NEXT.format(value="c_acctbal", more="", count="") + ", n AS (SELECT case_key, g, v, lo AS cv FROM w WHERE case_key IS NOT NULL AND lo IS NOT NULL UNION ALL SELECT case_key, g, v, hi AS cv FROM w WHERE case_key IS NOT NULL AND hi IS NOT NULL) SELECT case_key, control_key FROM (SELECT case_key, d.k AS control_key, row_number() OVER (PARTITION BY case_key ORDER BY abs(n.v - d.v), d.k) AS r FROM n JOIN d ON n.g = d.g AND n.cv = d.v) x WHERE r = 1",
    "zscore": "WITH s AS (SELECT avg(log10(n_chars + 1)) AS m, coalesce(nullif(stddev_pop(log10(n_chars + 1)), 0), 1) AS d FROM documents) SELECT doc_id, round((log10(n_chars + 1) - m) / d, 9) AS z FROM documents CROSS JOIN s",
    "quantile_bins": "WITH q AS (SELECT percentile_cont(0.2) WITHIN GROUP (ORDER BY value) AS a, percentile_cont(0.4) WITHIN GROUP (ORDER BY value) AS b, percentile_cont(0.6) WITHIN GROUP (ORDER BY value) AS c, percentile_cont(0.8) WITHIN GROUP (ORDER BY value) AS d FROM events) SELECT bin, count(*) AS n FROM (SELECT CASE WHEN value >= a THEN 1 ELSE 0 END + CASE WHEN value >= b THEN 1 ELSE 0 END + CASE WHEN value >= c THEN 1 ELSE 0 END + CASE WHEN value >= d THEN 1 ELSE 0 END AS bin FROM events CROSS JOIN q) t GROUP BY bin",
    "histogram": "SELECT least(CAST(floor(n_chars / 500e0) AS BIGINT), 24) AS bin, count(*) AS n FROM documents GROUP BY least(CAST(floor(n_chars / 500e0) AS BIGINT), 24)",
    "label_means": "SELECT l.quality, count(*) AS n, round(avg(d.n_chars), 6) AS mean_chars, round(avg(CASE WHEN d.n_chars > 1000 THEN 1e0 ELSE 0e0 END), 9) AS long_share FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality",
    "cohort_summary": "SELECT count(*) AS n_rows, sum(l.toxic) AS positives, round(avg(l.toxic), 9) AS prevalence, count(DISTINCT d.source) AS entities FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "boolean_fraction": "SELECT user_id, round(avg(CASE WHEN value > 50 THEN 1e0 ELSE 0e0 END), 9) AS high_share FROM events GROUP BY user_id",
    "topk": "SELECT user_id, n, spread FROM (SELECT user_id, count(*) AS n, round(max(value) - min(value), 6) AS spread FROM events WHERE event_type = 'purchase' GROUP BY user_id) a ORDER BY n DESC, spread DESC, user_id LIMIT 6",
    "sort_multi": "SELECT c_mktsegment, c_acctbal, c_custkey FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey",
    "shard_assign": "SELECT shard, count(*) AS n, min(user_id) AS first_key FROM (SELECT user_id, (row_number() OVER (ORDER BY user_id) - 1) % 16 AS shard FROM (SELECT DISTINCT user_id FROM events) u) t GROUP BY shard",
    "partition_cover": "SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, count(*) - count(o_orderkey) AS n_null, max(o_orderkey) - min(o_orderkey) + 1 AS extent FROM orders",
    "union_validated": "SELECT shard, count(*) AS n, count(DISTINCT k) AS n_keys FROM (SELECT o_orderkey AS k, o_orderkey % 4 AS shard FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey AS k, o_orderkey % 4 AS shard FROM orders WHERE o_orderkey % 2 <> 0) t GROUP BY shard",
    "precision_recall": "WITH " + _SCORED + " SELECT round(sum(CASE WHEN score >= 200 THEN label ELSE 0 END) / (1e0 * greatest(sum(CASE WHEN score >= 200 THEN 1 ELSE 0 END), 1)), 9) AS precision_at, round(sum(CASE WHEN score >= 200 THEN label ELSE 0 END) / (1e0 * greatest(sum(label), 1)), 9) AS recall_at FROM scored",
    "operating_points": "WITH " + _SCORED + ", t AS (SELECT q, CASE q WHEN 1 THEN a WHEN 2 THEN b ELSE c END AS threshold FROM (SELECT percentile_cont(0.9) WITHIN GROUP (ORDER BY score) AS a, percentile_cont(0.95) WITHIN GROUP (ORDER BY score) AS b, percentile_cont(0.99) WITHIN GROUP (ORDER BY score) AS c FROM scored WHERE label = 0) z CROSS JOIN (SELECT CAST(q AS BIGINT) AS q FROM (SELECT EACH((1, 3)) AS q) e) g) SELECT q, round(threshold, 6) AS threshold, sum(CASE WHEN score > threshold THEN label ELSE 0 END) AS tp, sum(CASE WHEN score > threshold THEN 1 - label ELSE 0 END) AS fp FROM scored CROSS JOIN t GROUP BY q, threshold",
    "negative_quantile_threshold": "WITH " + _SCORED + " SELECT round(percentile_cont(0.95) WITHIN GROUP (ORDER BY score), 6) AS threshold FROM scored WHERE label = 0",
    "composition": "SELECT doc_id, " + ", ".join(f"round({sequences._share(letters, 't')} / (1e0 * length(t)), 9) AS {name}" for name, letters in sequences._COMPOSITION.items()) + f", round(({sequences._share('KR', 't')} - {sequences._share('DE', 't')}) / (1e0 * length(t)), 9) AS charge FROM (SELECT doc_id, translate(text, '{sequences._SMALL}', '{sequences._LARGE}') AS t FROM documents WHERE length(text) > 0) d",
    "ols_simple": "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 9) AS r2 FROM lineitem GROUP BY l_returnflag",
    "t_summary": "WITH " + _FRACTIONS + " SELECT mark, count(*) AS n, round(avg(obs - nul), 9) AS mean_effect, round(stddev_samp(obs - nul) / sqrt(count(*)), 9) AS se, round(avg(obs - nul) / nullif(stddev_samp(obs - nul) / sqrt(count(*)), 0), 6) AS t FROM eff GROUP BY mark",
    "direct_contrasts": "WITH " + _FRACTIONS + " SELECT b.mark AS control, count(*) AS n, round(avg((a.obs - a.nul) - (b.obs - b.nul)), 9) AS mean_difference FROM eff a JOIN eff b ON a.entity = b.entity WHERE a.mark = 'purchase' AND b.mark <> 'purchase' GROUP BY b.mark",
    "audit_check": "WITH o AS (SELECT 'regions' AS k, 1e0 * count(*) AS observed FROM region UNION ALL SELECT 'nations' AS k, 1e0 * count(*) AS observed FROM nation UNION ALL SELECT 'nations_a_region' AS k, (SELECT count(*) FROM nation) / (1e0 * count(*)) AS observed FROM region UNION ALL SELECT 'third' AS k, count(*) / 3e0 AS observed FROM region), e AS (SELECT 'regions' AS k, 5e0 AS expected UNION ALL SELECT 'nations' AS k, 24.9999e0 AS expected UNION ALL SELECT 'nations_a_region' AS k, 5.000000001e0 AS expected UNION ALL SELECT 'third' AS k, 1.666666666666e0 AS expected UNION ALL SELECT 'absent' AS k, 1e0 AS expected) SELECT e.k, expected, coalesce(abs(observed - expected) <= greatest(1e-10, abs(expected) * 1e-9), false) AS passed FROM e LEFT JOIN o ON o.k = e.k",
    "result_ledger": "WITH " + _FRACTIONS + " SELECT concat('fold:', mark) AS claim_id, round(avg(obs) / avg(nul), 9) AS value, 'ratio' AS unit FROM eff GROUP BY mark UNION ALL SELECT concat('n:', mark) AS claim_id, CAST(count(*) AS DOUBLE) AS value, 'entities' AS unit FROM eff GROUP BY mark",
    "evidence_restricted": "WITH ev AS (SELECT entity, mark, pos, count(DISTINCT CAST(floor(value / 50) AS BIGINT)) AS k FROM {hours} h GROUP BY entity, mark, pos), tiers AS (SELECT 'all' AS tier, entity, mark, pos FROM ev UNION ALL SELECT 'two_sources' AS tier, entity, mark, pos FROM ev WHERE k >= 2), near AS (SELECT tier, entity, mark, count(*) OVER (PARTITION BY tier, entity, mark ORDER BY pos RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) - 1 AS d FROM tiers) SELECT tier, entity, mark, count(*) AS n, sum(d) AS twice_pairs FROM near GROUP BY tier, entity, mark",
    "region_recall": "WITH " + _CHAIN + f", along AS (SELECT entity, e + 15 AS place, s, CAST(NULL AS BIGINT) AS other FROM islands WHERE mark = 'purchase' UNION ALL SELECT entity, pos AS place, CAST(NULL AS BIGINT) AS s, pos AS other FROM sites WHERE mark = 'view'), seen AS (SELECT s, max(other) {_UP} AS reached FROM along) SELECT count(*) AS n, sum(CASE WHEN reached >= s - 15 THEN 1 ELSE 0 END) AS found FROM seen WHERE s IS NOT NULL",
    "arm_ratio": "SELECT mark, round(avg(CASE WHEN pos < 360 THEN value END) / avg(CASE WHEN pos >= 360 THEN value END), 6) AS ratio FROM {hours} h GROUP BY mark",
    "local_covariates": "WITH v AS (SELECT entity, pos, avg(value) AS value FROM {hours} h GROUP BY entity, pos) SELECT entity, pos, round(avg(value) OVER (PARTITION BY entity ORDER BY pos RANGE BETWEEN 15 PRECEDING AND 15 FOLLOWING), 6) AS local_mean FROM v",
    "caliper_candidates": "WITH s AS (SELECT avg(c_acctbal) AS m, coalesce(nullif(stddev_pop(c_acctbal), 0), 1) AS d FROM customer), " + _NEXT.format(value="round((c_acctbal - m) / d, 9)", more=" CROSS JOIN s", count=", sum(m) OVER (PARTITION BY g ORDER BY v RANGE BETWEEN 0.5e0 PRECEDING AND 0.5e0 FOLLOWING) AS near") + " SELECT case_key, CAST(near AS BIGINT) AS candidates, round(least(v - lo, hi - v), 6) AS nearest FROM w WHERE case_key IS NOT NULL AND near > 0",
    "scaled_distance": "WITH s AS (SELECT avg(n_chars) AS m1, stddev_pop(n_chars) AS d1, avg(quality) AS m2, stddev_pop(quality) AS d2 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT d.doc_id, round(coalesce(pow((n_chars - m1) / (d1 + 1e-9), 2), 0) + coalesce(pow((quality - m2) / (d2 + 1e-9), 2), 0), 6) AS distance FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id CROSS JOIN s",
}
SHARED["deletion_summary"] = f"SELECT count(*) AS points, min(CASE WHEN group_fold < 1 THEN removed END) AS first_below, {', '.join(f'max(CASE WHEN pct = {p} THEN group_fold END) AS fold_at_{p}' for p in (0, 10, 25, 50, 75, 80))} FROM ({SHARED['adversarial_curve']}) c"
SHARED |= sequences.SHARED | alignments.SHARED | controls.build(_CHAIN, _SITES, _FRACTIONS)


def _exact_mean(x: str) -> str:
    """avg(x) that is the same in any order: as it is for one or two values, by an exact sum for more; values that no decimal holds are summed as they come."""
    x_ = f"try_cast({x} AS DECIMAL(38, 18))"
    return f"coalesce(CAST(CASE WHEN count({x}) > 2 AND count({x}) = count({x_}) THEN try_sum({x_}) END AS DOUBLE) / count({x}), avg({x}))"


#: What Spark runs in place of a shared text: means that a limit is held against.
SPARK = {"control_windows": SHARED["control_windows"].replace("avg(value)", _exact_mean("value")).replace("avg(v.value)", _exact_mean("v.value"))}

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def spark_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    # Spark works a common table out anew wherever it is named: effects that are named twice are written once.
    head = "WITH " + _FRACTIONS
    once = text.startswith(head) and len(re.findall(r"\b(?:FROM|JOIN) eff\b", text[len(head) :])) + 2 * ("bucketed AS" in text) > 1
    effects = spark_query(head + " SELECT * FROM eff") if once else None
    if once:
        text = "WITH eff AS (SELECT * FROM {effects})" + text[len(head) :]
    used = [t for t in _TABLES if re.search(rf"(?:FROM|JOIN) {t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {t: table(spark, sf_dir, t) for t in used}
        if effects:
            frames["effects"] = files.saved(spark, effects(spark, sf_dir), "effects")
        if "{hours}" in text:
            frames["hours"] = hours(table(spark, sf_dir, "events"))
        if "{symbols}" in text:
            frames["symbols"] = sequences.symbols(table(spark, sf_dir, "documents"))
        marked = re.sub(rf"(FROM|JOIN) ({'|'.join(_TABLES)})\b", r"\1 {\2}", text).replace("EACH((", "explode(sequence(")
        return spark.sql(marked.replace("VARCHAR(20)", "STRING"), **frames)

    return run


def duck_query(text: str) -> str:
    return text.replace("{hours} h", DUCK_HOURS + " h").replace("{symbols} s", sequences.DUCK_SYMBOLS + " s").replace("EACH((", "unnest(generate_series(")
