"""Substring spans, position scores and composition in SQL that Spark and DuckDB share."""

from __future__ import annotations

from strandlake.plans.sequences import _CENTERS, _LARGE, _SMALL, _W, _share, _window

#: Letters other than S and T, and their hydropathy by Kyte and Doolittle.
_OTHERS = "ACDEFGHIKLMNPQRVWY"
_HYDROPATHY = {"A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "V": 4.2, "W": -0.9, "Y": -1.3}

_WEIGHT = " + ".join(f"coalesce((({k + 3} * 7 + ascii({'c' if not k else f'{'lead' if k > 0 else 'lag'}(c, {abs(k)}) {_W}'}) * 13) % 17 - 8) / 4e0, 0e0)" for k in range(-3, 4))
_COUNTS = ", ".join([_share(_OTHERS, "w") + " AS size", *(f"length(w) - length(replace(w, '{x}', '')) AS n_{x}" for x in _OTHERS)])
# Hydropathy is summed in tenths: whole numbers have the same sum in any order.
_PROFILE = ", ".join([*(f"round(n_{x} / (1e0 * greatest(size, 1)), 9) AS {x.lower()}" for x in _OTHERS), f"round(({' + '.join(f'{round(10 * v)} * n_{x}' for x, v in _HYDROPATHY.items())}) / (1e1 * greatest(size, 1)), 9) AS hydropathy"])
_SEGMENTS = " UNION ALL ".join(f"SELECT doc_id, CAST(center AS BIGINT) AS center, CAST({r} AS BIGINT) AS radius, {_window(r)} AS w FROM ({_CENTERS}) c" for r in (10, 20, 40))


SHARED: dict[str, str] = {
    # A matrix by rule scores the seven symbols around each S or T; percentiles come from the few distinct scores.
    "pssm_score": f"WITH w AS (SELECT doc_id, c, {_WEIGHT} AS score FROM {{symbols}} s), k AS (SELECT doc_id, score FROM w WHERE c IN ('S', 'T')), n AS (SELECT score, count(*) AS n FROM k GROUP BY score), p AS (SELECT score, 100e0 * sum(n) OVER (ORDER BY score) / sum(n) OVER () AS percentile FROM n) SELECT doc_id, count(*) AS n_sites, CAST(sum(CASE WHEN percentile > 90 THEN 1 ELSE 0 END) AS BIGINT) AS n_high, round(max(percentile), 6) AS best FROM k JOIN p ON k.score = p.score GROUP BY doc_id",
    "nonst_composition": f"SELECT doc_id, center, radius, {_PROFILE} FROM (SELECT doc_id, center, radius, {_COUNTS} FROM ({_SEGMENTS}) w) k",
}
