"""Sequence features in SQL that Spark and DuckDB share. {symbols} stands for the documents as (doc_id, pos, c), c in capitals where it is an ASCII letter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SMALL, _LARGE = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The symbols in DuckDB; Spark has them from symbols().
DUCK_SYMBOLS = f"(SELECT doc_id, CAST(generate_subscripts(l, 1) AS BIGINT) AS pos, unnest(l) AS c FROM (SELECT doc_id, regexp_extract_all(translate(text, '{_SMALL}', '{_LARGE}'), '(?s:.)') AS l FROM documents) q)"


def symbols(docs: DataFrame) -> DataFrame:
    """One row for each symbol; positions count from 1. Only ASCII letters change, so that positions stay those of the text."""
    split = docs.select("doc_id", F.posexplode(F.split(F.translate("text", _SMALL, _LARGE), "")).alias("i", "c"))
    return split.where("c <> ''").select("doc_id", (F.col("i") + 1).cast("long").alias("pos"), "c")


_W = "OVER (PARTITION BY doc_id ORDER BY pos)"
_CHARGE = "CASE WHEN c IN ('K', 'R') THEN 1e0 WHEN c IN ('D', 'E') THEN -1e0 ELSE 0e0 END"
_GAPS = f"""m AS (SELECT doc_id, pos, CASE WHEN c IN ('S', 'T') THEN 1e0 ELSE 0e0 END AS f FROM {{symbols}} s),
gaps AS (SELECT doc_id, pos - lag(pos) {_W} AS gap FROM m WHERE f = 1e0),
g AS (SELECT doc_id, avg(gap) AS gm, stddev_pop(gap) AS gs, avg(CASE WHEN gap = 1 THEN 1e0 WHEN gap > 1 THEN 0e0 END) AS g1, avg(CASE WHEN gap <= 3 THEN 1e0 WHEN gap > 3 THEN 0e0 END) AS g3, avg(CASE WHEN gap <= 5 THEN 1e0 WHEN gap > 5 THEN 0e0 END) AS g5 FROM gaps GROUP BY doc_id)"""
_LAGS = (1, 2, 3, 5, 8, 10)
_OFFSETS = (-5, -4, -3, -2, -1, 1, 2, 3, 4, 5)


def _at(k: int) -> str:
    return f"{'lead' if k > 0 else 'lag'}(c, {abs(k)}) {_W}"


def _share(letters: str, segment: str = "seg") -> str:
    """Occurrences of the letters in the segment."""
    return f"({len(letters)} * length({segment})" + "".join(f" - length(replace({segment}, '{x}', ''))" for x in letters) + ")"


#: The letters that each feature of a window counts.
_FEATURES = {"st": "ST", "acidic": "DE", "aromatic": "FWY", "alanine": "A", "proline": "P", "qn": "QN", "disordered": "PESQKRGDN"}
#: The letters whose shares make a composition, beside the net charge of K and R over D and E.
_COMPOSITION = {"acidic": "DE", "alanine": "A", "aromatic": "FWY", "proline": "P", "qn": "QN", "aliphatic": "AVILM"}
_CENTERS = f"SELECT doc_id, t, EACH((11, length(t) - 10, 10)) AS center FROM (SELECT doc_id, translate(text, '{_SMALL}', '{_LARGE}') AS t FROM documents WHERE length(text) >= 21) x"


def _window(radius: int) -> str:
    start = f"greatest(1, center - {radius})"
    return f"substr(t, CAST({start} AS INTEGER), CAST(center + {radius} - {start} + 1 AS INTEGER))"


_TRANSFER = ", ".join(f"round({_share(letters, f'w{r}')} / (1e0 * length(w{r})), 9) AS {name}_{r}" for r in (10, 20, 40) for name, letters in _FEATURES.items()) + "".join(f", round(({_share('KR', f'w{r}')} - {_share('DE', f'w{r}')}) / (1e0 * length(w{r})), 9) AS charge_{r}" for r in (10, 20, 40))
_PADDED = ", ".join("c" if not k else f"coalesce({_at(k)}, '_')" for k in range(-7, 8))

SHARED: dict[str, str] = {
    "range_grid": "SELECT CAST(p AS BIGINT) AS removed_pct FROM (SELECT EACH((0, 80)) AS p) t",
    "residue_explode": "SELECT doc_id, pos, c FROM {symbols} s WHERE c IN ('S', 'T')",
    "geometry": f"WITH {_GAPS} SELECT a.doc_id, round(density, 9) AS density, round(coalesce(gm, len), 9) AS gap_mean, round(coalesce(gs, 0), 6) AS gap_sd, round(coalesce(g5, 0), 9) AS close_share FROM (SELECT doc_id, count(*) AS len, avg(f) AS density FROM m GROUP BY doc_id) a LEFT JOIN g ON a.doc_id = g.doc_id",
    "st_geometry": f"WITH {_GAPS}, p AS (SELECT doc_id, f, {', '.join(f'f * lead(f, {k}) {_W} AS a{k}' for k in _LAGS)} FROM m) SELECT a.doc_id, round(density, 9) AS density, round(coalesce(gm, len), 9) AS gap_mean, round(coalesce(gs / (gm + 1e-9), 1), 6) AS gap_cv, round(coalesce(g1, 0), 9) AS adjacent, round(coalesce(g3, 0), 9) AS close_share, {', '.join(f'round(a{k}, 9) AS autocorr_{k}' for k in _LAGS)} FROM (SELECT doc_id, count(*) AS len, avg(f) AS density, {', '.join(f'coalesce(avg(a{k}), 0) AS a{k}' for k in _LAGS)} FROM p GROUP BY doc_id) a LEFT JOIN g ON a.doc_id = g.doc_id",
    "scd": f"WITH q AS (SELECT doc_id, pos, CAST(floor((pos - 1) / 50e0) AS BIGINT) AS tile, {_CHARGE} AS q FROM {{symbols}} s), t AS (SELECT doc_id, tile, count(*) AS len FROM q GROUP BY doc_id, tile), p AS (SELECT a.doc_id, a.tile, sum(a.q * b.q * sqrt(b.pos - a.pos)) AS total FROM q a JOIN q b ON a.doc_id = b.doc_id AND a.tile = b.tile WHERE a.q <> 0 AND b.q <> 0 AND a.pos < b.pos GROUP BY a.doc_id, a.tile) SELECT t.doc_id, t.tile, round(coalesce(total / len, 0), 6) AS scd FROM t LEFT JOIN p ON t.doc_id = p.doc_id AND t.tile = p.tile",
    "charge_blockiness": f"WITH q AS (SELECT doc_id, CAST(floor((pos - 1) / 50e0) AS BIGINT) AS tile, CAST(floor((pos - 1) / 5e0) AS BIGINT) AS block, {_CHARGE} AS q FROM {{symbols}} s), b AS (SELECT doc_id, tile, block, avg(q) AS mean_q, count(*) AS n FROM q GROUP BY doc_id, tile, block) SELECT doc_id, tile, round(CASE WHEN count(CASE WHEN n = 5 THEN 1 END) < 2 THEN 0e0 ELSE var_pop(CASE WHEN n = 5 THEN mean_q END) END, 6) AS blockiness FROM b GROUP BY doc_id, tile",
    "reduced_pairs": f"WITH r AS (SELECT doc_id, pos, CASE WHEN c IN ('A', 'V', 'L', 'I', 'M') THEN 'H' WHEN c IN ('F', 'W', 'Y') THEN 'R' WHEN c = 'P' THEN 'P' WHEN c = 'G' THEN 'G' WHEN c IN ('S', 'T') THEN 'O' WHEN c IN ('K', 'R', 'H') THEN '+' WHEN c IN ('D', 'E') THEN '-' WHEN c IN ('N', 'Q', 'C') THEN 'N' END AS k FROM {{symbols}} s), p AS (SELECT doc_id, k, lead(k, 3) {_W} AS k3 FROM r), n AS (SELECT doc_id, concat(k, k3) AS pair, count(*) AS n FROM p WHERE k IS NOT NULL AND k3 IS NOT NULL GROUP BY doc_id, concat(k, k3)) SELECT doc_id, pair, n, round(n / (1e0 * sum(n) OVER (PARTITION BY doc_id)), 9) AS share FROM n",
    "digest_intervals": f"WITH f AS (SELECT doc_id, pos, CASE WHEN c IN ('K', 'R') AND coalesce({_at(1)}, '_') <> 'P' THEN 1 ELSE 0 END AS cut FROM {{symbols}} s), k AS (SELECT doc_id, pos, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM f) SELECT doc_id, min(pos) AS interval_start, max(pos) AS interval_end FROM k GROUP BY doc_id, k",
    "padded_window": f"SELECT doc_id, pos, peptide FROM (SELECT doc_id, pos, c, concat({_PADDED}) AS peptide FROM {{symbols}} s) t WHERE c IN ('S', 'T')",
    "offset_profile": "WITH o AS (SELECT doc_id, c, " + ", ".join(f"CASE WHEN {_at(k)} = 'P' THEN 1e0 ELSE 0e0 END AS o{k + 5}" for k in _OFFSETS) + " FROM {symbols} s), d AS (SELECT doc_id, " + ", ".join(f"avg(o{k + 5}) AS o{k + 5}" for k in _OFFSETS) + " FROM o WHERE c IN ('S', 'T') GROUP BY doc_id) SELECT count(*) AS n, " + ", ".join(f"round(avg(o{k + 5}), 9) AS offset_{k + 5}" for k in _OFFSETS) + " FROM d",
    "scanner_tiles": f"SELECT doc_id, count(*) AS tiles, CAST(max(center) AS BIGINT) AS last_center FROM ({_CENTERS}) c GROUP BY doc_id",
    "window_substr": f"SELECT doc_id, CAST(center AS BIGINT) AS center, {_window(10)} AS seg FROM ({_CENTERS}) c",
    "transfer_features": f"SELECT doc_id, CAST(center AS BIGINT) AS center, {_TRANSFER} FROM (SELECT doc_id, center, {', '.join(f'{_window(r)} AS w{r}' for r in (10, 20, 40))} FROM ({_CENTERS}) c) w",
}
