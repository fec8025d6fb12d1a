"""DuckDB SQL of another shape for queries that Spark runs by windows and buckets: the plain joins that these stand for."""

from __future__ import annotations

from strandlake.plans import sql

_RANKED = sql._FRACTIONS + ", base AS (SELECT entity, obs, nul, obs - nul AS effect, row_number() OVER (ORDER BY obs - nul DESC, entity) AS r, count(*) OVER () AS total FROM eff WHERE mark = 'purchase')"
_FOLD = "(SELECT avg(z.obs) / avg(z.nul) FROM base z WHERE z.r > {r})"
_GRID = "(SELECT unnest(generate_series(0, 80)) AS pct) g"
_Z = "(SELECT c_custkey AS k, c_nationkey AS g, c_acctbal AS v, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT coalesce(nullif(stddev_pop(c_acctbal), 0), 1) FROM customer), 9) AS z, c_mktsegment = 'BUILDING' AS is_case FROM customer)"

PLAIN: dict[str, str] = {
    "rank_effects": "WITH " + _RANKED + " SELECT entity, r, total, round(effect, 9) AS effect FROM base",
    "single_step_curve": "WITH " + _RANKED + " SELECT r AS removed, round(" + _FOLD.format(r="base.r") + ", 9) AS group_fold FROM base",
    "first_crossing": "WITH " + _RANKED + " SELECT min(CASE WHEN " + _FOLD.format(r="base.r") + " < 1 THEN r END) AS first_below, count(*) AS n FROM base",
    "adversarial_curve": "WITH " + _RANKED + ", cut AS (SELECT pct, CAST(floor((SELECT count(*) FROM base) * pct / 100e0) AS BIGINT) AS removed FROM " + _GRID + ") SELECT pct, removed, count(*) AS left_n, round(avg(obs) / avg(nul), 9) AS group_fold FROM cut JOIN base ON r > removed GROUP BY pct, removed",
    "random_envelope": "WITH " + _RANKED + ", shuffled AS (SELECT rep, obs, nul, row_number() OVER (PARTITION BY rep ORDER BY md5(concat(entity, ':', rep)), entity) AS k, total FROM base, (SELECT unnest(generate_series(1, 500)) AS rep) g), folds AS (SELECT pct, CAST(floor(total * pct / 100e0) AS BIGINT) AS removed, rep, avg(obs) / avg(nul) AS fold FROM shuffled JOIN " + _GRID + " ON k > floor(total * pct / 100e0) GROUP BY pct, total, rep) SELECT pct, removed, count(*) AS n, round(quantile_cont(fold, 0.025), 9) AS lo, round(median(fold), 9) AS mid, round(quantile_cont(fold, 0.975), 9) AS hi FROM folds GROUP BY pct, removed",
    "tile_labels": "WITH " + sql._CHAIN + " SELECT p.entity, p.pos, max(CASE WHEN p.pos BETWEEN i.s - 15 AND i.e + 15 THEN 1 ELSE 0 END) AS label FROM (SELECT DISTINCT entity, pos FROM sites) p LEFT JOIN islands i ON p.entity = i.entity AND i.mark = 'purchase' GROUP BY p.entity, p.pos",
    "span_distance": "WITH " + sql._CHAIN + " SELECT p.entity, p.pos, min(greatest(i.s - p.pos, p.pos - i.e, 0)) AS distance FROM (SELECT DISTINCT entity, pos FROM sites) p JOIN islands i ON p.entity = i.entity AND i.mark = 'purchase' GROUP BY p.entity, p.pos",
    "distance_profile": "WITH " + sql._CHAIN + ", d AS (SELECT p.entity, p.mark, min(greatest(i.s - p.pos, p.pos - i.e, 0)) AS x FROM sites p JOIN islands i ON p.entity = i.entity AND i.mark = 'purchase' WHERE p.mark IN ('view', 'click') GROUP BY p.entity, p.mark, p.pos), f AS (SELECT radius, entity, mark, avg((x <= radius)::INT) AS share FROM d, (SELECT unnest(generate_series(0, 60)) AS radius) g GROUP BY radius, entity, mark) SELECT radius, mark, round(avg(share), 9) AS mean_share FROM f GROUP BY radius, mark",
    "interval_overlap": "WITH " + sql._CHAIN + " SELECT count(*) AS n, sum(CASE WHEN EXISTS (SELECT 1 FROM islands b WHERE b.mark = 'view' AND b.entity = a.entity AND b.s <= a.e AND b.e >= a.s) THEN 1 ELSE 0 END) AS touched FROM islands a WHERE a.mark = 'purchase'",
    "region_recall": "WITH " + sql._CHAIN + " SELECT count(*) AS n, sum(CASE WHEN EXISTS (SELECT 1 FROM sites p WHERE p.mark = 'view' AND p.entity = a.entity AND p.pos >= a.s - 15 AND p.pos <= a.e + 15) THEN 1 ELSE 0 END) AS found FROM islands a WHERE a.mark = 'purchase'",
    "pair_counts_multi": "WITH " + sql._SITES + ", d AS (SELECT a.mark, a.pos - b.pos AS gap FROM sites a JOIN sites b USING (entity, mark) WHERE a.pos > b.pos AND a.pos - b.pos <= 50) SELECT mark, count(*) FILTER (WHERE gap <= 2) AS r2, count(*) FILTER (WHERE gap <= 10) AS r10, count(*) AS r50 FROM d GROUP BY mark",
    "nn_match": "WITH z AS (SELECT * FROM " + _Z + "), p AS (SELECT a.k AS case_key, b.k AS control_key, row_number() OVER (PARTITION BY a.k ORDER BY abs(a.v - b.v), b.k) AS r FROM z a JOIN z b ON a.g = b.g WHERE a.is_case AND NOT b.is_case) SELECT case_key, control_key FROM p WHERE r = 1",
    "caliper_candidates": "WITH z AS (SELECT * FROM " + _Z + ") SELECT a.k AS case_key, count(*) AS candidates, round(min(abs(a.z - b.z)), 6) AS nearest FROM z a JOIN z b ON a.g = b.g WHERE a.is_case AND NOT b.is_case AND b.z BETWEEN a.z - 0.5 AND a.z + 0.5 GROUP BY a.k",
    "multiscale": "WITH " + sql._SITES + ", radii AS (SELECT unnest([5, 10, 25]) AS r), n AS (SELECT entity, mark, count(*) AS k FROM sites GROUP BY ALL HAVING count(*) >= 3), close AS (SELECT r, a.entity, a.mark, count(*) AS e FROM sites a JOIN sites b USING (entity, mark) JOIN radii ON b.pos > a.pos AND b.pos - a.pos <= r GROUP BY ALL), pool AS (SELECT DISTINCT entity, pos FROM sites), np AS (SELECT entity, count(*) AS k FROM pool GROUP BY ALL), cp AS (SELECT r, a.entity, count(*) AS e FROM pool a JOIN pool b USING (entity) JOIN radii ON b.pos > a.pos AND b.pos - a.pos <= r GROUP BY ALL), eff AS (SELECT n.entity, n.mark, coalesce(c.e, 0) / (n.k * (n.k - 1) / 2) - coalesce(p.e, 0) / (np.k * (np.k - 1) / 2) AS x FROM n CROSS JOIN radii LEFT JOIN close c ON c.entity = n.entity AND c.mark = n.mark AND c.r = radii.r JOIN np ON np.entity = n.entity LEFT JOIN cp p ON p.entity = n.entity AND p.r = radii.r) SELECT entity, mark, bool_and(x > 0) AS positive_at_all, round(min(x), 9) AS least FROM eff GROUP BY ALL",
}
