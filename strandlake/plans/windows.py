"""Sequence features over the documents; each query has SQL over rows of single characters as its oracle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators import windows
from strandlake.operators.windows import LAGS, PAIRS, Symbols
from strandlake.plans import alignments, sequences
from strandlake.plans.base import table

_RADII, _STEP = (10, 20, 40), 10


def _each(spark: SparkSession, sf_dir: str, fields: str, made) -> DataFrame:
    return windows.by_sequence(table(spark, sf_dir, "documents"), "doc_id", "text", fields, made)


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    def made(s: Symbols):
        g = windows.geometry(s, s.whole())
        return g["density"], g["gap_mean"], g["gap_sd"], g["close_5"]

    return _rounded(_rounded(_each(spark, sf_dir, "density double, gap_mean double, gap_sd double, close_share double", made), 9, "density", "gap_mean", "close_share"), 6, "gap_sd")


def st_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["density", "gap_mean", "gap_cv", "adjacent", "close_3", *(f"autocorr_{k}" for k in LAGS)]

    def made(s: Symbols):
        g = windows.geometry(s, s.whole())
        return [g[n] for n in names]

    rows = _each(spark, sf_dir, ", ".join(f"{n} double" for n in names), made).withColumnRenamed("close_3", "close_share")
    return _rounded(_rounded(rows, 9, "density", "gap_mean", "adjacent", "close_share", *(f"autocorr_{k}" for k in LAGS)), 6, "gap_cv")


def scd(spark: SparkSession, sf_dir: str) -> DataFrame:
    def made(s: Symbols):
        w = s.tiles(50)
        return np.arange(len(w[0])), windows.decoration(s, w)

    return _rounded(_each(spark, sf_dir, "tile long, scd double", made), 6, "scd")


def charge_blockiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    def made(s: Symbols):
        w = s.tiles(50)
        return np.arange(len(w[0])), windows.blockiness(s, w)

    return _rounded(_each(spark, sf_dir, "tile long, blockiness double", made), 6, "blockiness")


def reduced_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that a document has, how often, and their shares."""

    def made(s: Symbols):
        code = windows.pair_codes(s)
        n = np.bincount(code[code >= 0], minlength=len(PAIRS))
        some = np.flatnonzero(n)
        return [PAIRS[k] for k in some], n[some], n[some] / max(n.sum(), 1)

    return _rounded(_each(spark, sf_dir, "pair string, n long, share double", made), 9, "share")


def digest_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces between cuts, which follow K or R unless P comes next."""

    def made(s: Symbols):
        cut = s.isin("KR")
        cut[:-1] &= ~s.isin("P")[1:]
        ends = np.flatnonzero(cut) + 1
        ends = ends if len(ends) and ends[-1] == len(s) else np.append(ends, len(s))
        return np.append(1, ends[:-1] + 1), ends

    return _each(spark, sf_dir, "interval_start long, interval_end long", made)


def padded_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven symbols on both sides of each S and T, with _ beyond the ends."""

    def made(s: Symbols):
        at = np.flatnonzero(s.isin("ST"))
        upper = "".join(c.upper() if c.isascii() else c for c in s.text)
        padded = "_" * 7 + upper + "_" * 7
        return at + 1, [padded[i : i + 15] for i in at.tolist()]

    return _each(spark, sf_dir, "pos long, peptide string", made)


_OFFSETS = (-5, -4, -3, -2, -1, 1, 2, 3, 4, 5)


def offset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often P stands at each offset from S and T: the mean of documents' shares."""

    def made(s: Symbols):
        at = np.flatnonzero(s.isin("ST"))
        p = np.concatenate([np.zeros(5, bool), s.isin("P"), np.zeros(5, bool)])
        return [np.array([p[at + 5 + k].mean()]) if len(at) else np.zeros(0) for k in _OFFSETS]

    rows = _each(spark, sf_dir, ", ".join(f"o{k + 5} double" for k in _OFFSETS), made)
    return rows.agg(F.count("*").alias("n"), *(F.round(F.avg(f"o{k + 5}"), 9).alias(f"offset_{k + 5}") for k in _OFFSETS))


def _centers(s: Symbols) -> np.ndarray:
    return np.arange(_STEP + 1, len(s) - _STEP + 1, _STEP)


def _centred(s: Symbols):
    """(radius, windows) around each tenth symbol that has ten on both sides."""
    center = _centers(s)
    return [(r, s.centred(center, r)) for r in _RADII] if len(center) else []


_UPPER = str.maketrans(sequences._SMALL, sequences._LARGE)


def _shares(total: np.ndarray, w: windows.Windows, n: np.ndarray) -> np.ndarray:
    """Counts of windows over n, to nine places. Windows have 81 symbols at most, so that no quotient lies halfway and any engine rounds alike."""
    return np.round((total[w[1]] - total[w[0]]) / n, 9)


def transfer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of groups of letters and the net charge around each tenth symbol, a row for each centre."""
    names = [f"{n}_{r}" for r in _RADII for n in sequences._FEATURES] + [f"charge_{r}" for r in _RADII]

    def made(s: Symbols):
        around = _centred(s)
        if not around:
            return [[]] * (1 + len(names))
        totals = [windows.running(s.isin(x)) for x in sequences._FEATURES.values()]
        charge = windows.running(s.charge().astype(np.int64))
        shares = [_shares(t, w, w[1] - w[0]) for _, w in around for t in totals]
        return [_centers(s), *shares, *(_shares(charge, w, w[1] - w[0]) for _, w in around)]

    return _each(spark, sf_dir, "center long, " + ", ".join(f"{n} double" for n in names), made)


def nonst_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of each letter but S and T among such letters, and their mean hydropathy, around each tenth symbol."""
    letters = alignments._OTHERS
    tenths = np.zeros(128, np.int64)
    tenths[list(letters.encode())] = [round(10 * alignments._HYDROPATHY[x]) for x in letters]

    def made(s: Symbols):
        around = _centred(s)
        if not around:
            return [[]] * (3 + len(letters))
        w = tuple(np.concatenate([x[k] for _, x in around]) for k in (0, 1))
        size = np.maximum(windows.counted(s.isin(letters), w), 1)
        total = windows.running(tenths[s.code])
        center = _centers(s)
        return [np.tile(center, len(_RADII)), np.repeat(_RADII, len(center)), *(_shares(windows.running(s.isin(x)), w, size) for x in letters), _shares(total, w, 10 * size)]

    return _each(spark, sf_dir, "center long, radius long, " + ", ".join(f"{x.lower()} double" for x in letters) + ", hydropathy double", made)


def pssm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its S and T, those whose seven symbols score over the 90th percentile of all, and the largest percentile.

    Scores are 113 quarters, so that a document has a row for each score, not for each symbol, and the scores of all documents rank in one small table.
    """

    def made(s: Symbols):
        code = np.frombuffer(s.text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        code, at = np.where(s.code > 0, s.code, code), np.flatnonzero(s.isin("ST"))
        quarters = np.zeros(len(at), np.int64)
        for k in range(-3, 4):
            inside = (at + k >= 0) & (at + k < len(code))
            quarters[inside] += ((k + 3) * 7 + code[at[inside] + k] * 13) % 17 - 8
        n = np.bincount(quarters + 56, minlength=113)
        some = np.flatnonzero(n)
        return (some - 56) / 4, n[some]

    rows = _each(spark, sf_dir, "score double, n long", made)
    scores, below = rows.groupBy("score").agg(F.sum("n").alias("n")), W.orderBy("score")
    ranked = scores.select("score", (F.lit(100.0) * F.sum("n").over(below) / F.sum("n").over(W.partitionBy())).alias("percentile"))
    found = rows.join(F.broadcast(ranked), "score").groupBy("doc_id")
    return found.agg(F.sum("n").alias("n_sites"), F.sum(F.when(F.col("percentile") > 90, F.col("n")).otherwise(0)).alias("n_high"), F.round(F.max("percentile"), 6).alias("best"))


def window_substr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols around each tenth symbol."""

    def made(s: Symbols):
        start, end = s.centred(_centers(s), 10)
        text = s.text.translate(_UPPER)
        return _centers(s), [text[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]

    return _each(spark, sf_dir, "center long, seg string", made)


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many windows of 51 symbols around the centres 26, 36 ... of texts of at least 51, and the sum of their shares of small s and t."""

    def made(s: Symbols):
        start = np.arange(0, len(s) - 50, 10)
        code = np.frombuffer(s.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        total = windows.running((code == ord("s")) | (code == ord("t")))
        n = int((total[start + 51] - total[start]).sum()) if len(start) else 0
        return [[len(start)], [n]] if len(start) else [[], []]

    return _each(spark, sf_dir, "tiles long, n long", made).groupBy("doc_id").agg(F.sum("tiles").alias("tiles"), F.round(F.sum("n") / F.lit(51.0), 6).alias("st_sum"))


def _means(spark: SparkSession, sf_dir: str, names: list[str], features, coarse: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, radius, n_windows, names): means over a document's windows of each radius."""

    def made(s: Symbols):
        around = _centred(s)
        if not around:
            return [[]] * (2 + len(names))
        # All radii at once, so that running counts of the text are made once for all.
        n = len(around[0][1][0])
        values = features(s, tuple(np.concatenate([w[k] for _, w in around]) for k in (0, 1)))
        return [[r for r, _ in around], [n] * len(around), *([x[i * n : (i + 1) * n].mean() for i in range(len(around))] for x in values)]

    rows = _each(spark, sf_dir, "radius int, n_windows long, " + ", ".join(f"{n} double" for n in names), made)
    return _rounded(_rounded(rows, 9, *(n for n in names if n not in coarse)), 7, *coarse)


def window_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(spark, sf_dir, [*windows.COMPOSITION, "charge"], lambda s, w: windows.composition(s, w).values())


_GEOMETRY = ["density", "gap_mean", "gap_sd", "gap_cv", "adjacent", "close_3", "close_5", *(f"autocorr_{k}" for k in LAGS)]


def window_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(spark, sf_dir, _GEOMETRY, lambda s, w: windows.geometry(s, w).values(), ("gap_sd", "gap_cv"))


def window_charge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(spark, sf_dir, ["scd", "blockiness"], lambda s, w: (windows.decoration(s, w), windows.blockiness(s, w)), ("scd",))


_PAIR_NAMES = [f"p{i}" for i in range(len(PAIRS))]


def window_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p0 .. p63: shares of the pairs of classes, in the order of the classes."""
    return _means(spark, sf_dir, _PAIR_NAMES, lambda s, w: windows.pairs(s, w))


def _parts(extra: str) -> str:
    """A row for each window in DuckDB: w, its symbols, and n, their number."""
    return f"""WITH seqs AS (SELECT doc_id, translate(text, '{sequences._SMALL}', '{sequences._LARGE}') AS t FROM documents WHERE length(text) >= 21),
wins AS (SELECT doc_id, radius, substr(t, greatest(1, c - radius), c + radius - greatest(1, c - radius) + 1) AS w FROM (SELECT doc_id, t, unnest(range(11, length(t) - 9, 10)) AS c FROM seqs) x CROSS JOIN (SELECT unnest([10, 20, 40])::INTEGER AS radius)),
f AS (SELECT doc_id, radius, w, length(w) AS n{extra} FROM wins)"""


def _size(letters: str) -> str:
    return f"(length(w) - length(translate(w, '{letters}', '')))"


def _averages(values: dict[str, str], places: dict[str, int] | None = None) -> str:
    return "SELECT doc_id, radius, count(*) AS n_windows, " + ", ".join(f"round(avg({v}), {(places or {}).get(k, 9)}) AS {k}" for k, v in values.items())


_AT = ", list_filter(range(1, length(w) + 1), lambda i: w[i] IN ('S', 'T')) AS spot"
_GAPPED = _parts(_AT) + ", g AS (SELECT *, list_transform(range(2, len(spot) + 1), lambda i: spot[i] - spot[i - 1]) AS gap FROM f)"
_GEOMETRY_SQL = {
    "density": "len(spot) / n", "gap_mean": "coalesce(list_avg(gap), n)", "gap_sd": "coalesce(list_stddev_pop(gap), 0)", "gap_cv": "coalesce(list_stddev_pop(gap) / (list_avg(gap) + 1e-9), 1)",
    **{k: f"coalesce(len(list_filter(gap, lambda g: g <= {m})) / nullif(len(gap), 0), 0)" for k, m in (("adjacent", 1), ("close_3", 3), ("close_5", 5))},
    **{f"autocorr_{k}": f"CASE WHEN n > {k} THEN len(list_filter(spot, lambda i: list_contains(spot, i + {k}))) / (n - {k}) ELSE 0 END" for k in LAGS},
}
_CHARGED = _parts(", list_filter(range(1, length(w) + 1), lambda i: w[i] IN ('K', 'R', 'D', 'E')) AS spot")
_Q = lambda i: f"(CASE WHEN w[{i}] IN ('K', 'R') THEN 1 WHEN w[{i}] IN ('D', 'E') THEN -1 ELSE 0 END)"
_CHARGE_SQL = {
    "scd": f"coalesce(list_sum(list_transform(spot, lambda i: {_Q('i')} * coalesce(list_sum(list_transform(list_filter(spot, lambda j: j > i), lambda j: {_Q('j')} * sqrt(j - i))), 0))), 0) / n",
    "blockiness": f"CASE WHEN n < 10 THEN 0 ELSE list_var_pop(list_transform(range(0, n // 5), lambda b: list_sum(list_transform(range(1, 6), lambda k: {_Q('5 * b + k')})) / 5)) END",
}
_REDUCED = _parts(f", translate(w, '{''.join(windows.CLASSES.values())}', '{''.join(k * len(v) for k, v in zip('abcdefgh', windows.CLASSES.values(), strict=True))}') AS k") + ", p AS (SELECT doc_id, radius, list_filter(list_transform(range(1, n - 2), lambda i: k[i] || k[i + 3]), lambda x: regexp_full_match(x, '[a-h]{2}')) AS p FROM f)"
_PAIR_SQL = {n: f"coalesce(len(list_filter(p, lambda x: x = '{a}{b}')) / nullif(len(p), 0), 0)" for n, (a, b) in zip(_PAIR_NAMES, [(a, b) for a in "abcdefgh" for b in "abcdefgh"], strict=True)}

#: Queries with SQL of single characters or of substrings that was once shared, and windows with SQL of lists.
BY_CHARACTER = (geometry, st_geometry, scd, charge_blockiness, reduced_pairs, digest_intervals, padded_window, offset_profile, transfer_features, nonst_composition, pssm_score, window_substr)
BY_LIST = {
    window_composition: _parts("") + _averages({k: f"{_size(x)} / n" for k, x in windows.COMPOSITION.items()} | {"charge": f"({_size('KR')} - {_size('DE')}) / n"}).replace("SELECT", " SELECT", 1) + " FROM f GROUP BY doc_id, radius",
    window_geometry: _GAPPED + " " + _averages(_GEOMETRY_SQL, {"gap_sd": 7, "gap_cv": 7}) + " FROM g GROUP BY doc_id, radius",
    window_charge: _CHARGED + " " + _averages(_CHARGE_SQL, {"scd": 7}) + " FROM f GROUP BY doc_id, radius",
    window_pairs: _REDUCED + " " + _averages(_PAIR_SQL) + " FROM p GROUP BY doc_id, radius",
}
