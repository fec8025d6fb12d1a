"""Control windows beside regions, and windowed features of sites, in SQL that Spark and DuckDB share.

A user's islands are regions of the document with the same number; the event values, over 100, stand for disorder.
"""

from __future__ import annotations

from strandlake.plans.sequences import _LARGE, _SMALL, _share

#: The twenty amino acids, their hydropathy by Kyte and Doolittle in tenths, and their reduced classes.
_LETTERS = "ARNDCQEGHILKMFPSTWYV"
_TENTHS = {"A": 18, "R": -45, "N": -35, "D": -35, "C": 25, "Q": -35, "E": -35, "G": -4, "H": -32, "I": 45, "L": 38, "K": -39, "M": 19, "F": 28, "P": -16, "S": -8, "T": -7, "W": -9, "Y": -13, "V": 42}
_CLASSES = {"H": "AVLIM", "R": "FWY", "P": "P", "G": "G", "O": "ST", "+": "KRH", "-": "DE", "N": "NQC"}
#: Bytes of positions to a bucket, by which windows meet the values in them.
_BUCKET = 64

_REGIONS = f"""seqs AS (SELECT doc_id AS entity, translate(text, '{_SMALL}', '{_LARGE}') AS t, CAST(length(text) AS BIGINT) AS len FROM documents),
regions AS (SELECT i.entity, i.s + 1 AS s, i.e + 1 AS e, i.e - i.s + 1 AS n, q.t, q.len FROM islands i JOIN seqs q ON q.entity = i.entity WHERE i.mark = 'purchase' AND i.e + 1 <= q.len)"""


def _st(text: str) -> str:
    return f"{_share('ST', text)} / (1e0 * length({text}))"


def _part(start: str, size: str = "n") -> str:
    return f"substr(t, CAST({start} AS INTEGER), CAST({size} AS INTEGER))"


def build(chain: str, sites: str, fractions: str) -> dict[str, str]:
    """The queries over the views that the arguments make."""
    segments = ", ".join(f"substr(t, CAST(greatest(1, pos - {r}) AS INTEGER), CAST(pos + {r} - greatest(1, pos - {r}) + 1 AS INTEGER)) AS w{r}" for r in (10, 20, 40))
    legacy = []
    for r in (10, 20, 40):
        w = f"w{r}"
        size = f"(1e0 * length({w}))"
        hydropathy = " + ".join(f"{v} * ({_share(x, w)})" for x, v in _TENTHS.items())
        legacy += [f"round({_share('ST', w)} / {size}, 9) AS st_{r}", f"round({_share('DEFWY', w)} / {size}, 9) AS sticky_{r}", f"round(({_share('KR', w)} - {_share('DE', w)}) / {size}, 9) AS charge_{r}", f"round(({hydropathy}) / (10 * {size}), 9) AS hydropathy_{r}", f"round({_share('P', w)} / {size}, 9) AS proline_{r}", f"round({_share('QN', w)} / {size}, 9) AS qn_{r}"]
    classes, members = "".join(k * len(v) for k, v in _CLASSES.items()), "".join(_CLASSES.values())
    charge = lambda c: f"CASE WHEN {c} IN ('K', 'R') THEN 1e0 WHEN {c} IN ('D', 'E') THEN -1e0 ELSE 0e0 END"
    spots = f"{sites}, seqs AS (SELECT doc_id AS entity, translate(text, '{_SMALL}', '{_LARGE}') AS t, CAST(length(text) AS BIGINT) AS len FROM documents), spots AS (SELECT DISTINCT x.entity, x.pos + 1 AS pos, q.t, q.len FROM sites x JOIN seqs q ON q.entity = x.entity WHERE x.mark = 'purchase' AND x.pos < q.len AND q.len >= 10)"
    return {
        # Windows as long as the region, half a length apart, a length away from every region, alike in S and T and in disorder; the middle one.
        "control_windows": f"""WITH {chain}, {_REGIONS},
cand AS (SELECT entity, s, e, n, t, EACH((1, len - n + 1, greatest(1, CAST(floor(n / 2e0) AS BIGINT)))) AS c FROM regions WHERE len >= n),
free AS (SELECT x.* FROM cand x WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.entity = x.entity AND x.c + x.n - 1 >= r.s - x.n AND x.c <= r.e + x.n)),
v AS (SELECT entity, pos + 1 AS pos, CAST(floor((pos + 1) / {_BUCKET}e0) AS BIGINT) AS b, avg(value) / 100e0 AS value FROM {{hours}} h GROUP BY entity, pos),
wins AS (SELECT entity, s, n, c FROM free UNION ALL SELECT entity, s, n, s AS c FROM regions),
cover AS (SELECT entity, s, n, c, EACH((CAST(floor(c / {_BUCKET}e0) AS BIGINT), CAST(floor((c + n - 1) / {_BUCKET}e0) AS BIGINT))) AS b FROM wins),
means AS (SELECT w.entity, w.s, w.c, avg(v.value) AS disorder FROM cover w JOIN v ON v.entity = w.entity AND v.b = w.b WHERE v.pos BETWEEN w.c AND w.c + w.n - 1 GROUP BY w.entity, w.s, w.c),
judged AS (SELECT f.entity, f.s, f.e, f.c, f.n, row_number() OVER (PARTITION BY f.entity, f.s ORDER BY f.c) AS k, count(*) OVER (PARTITION BY f.entity, f.s) AS m FROM free f JOIN means a ON a.entity = f.entity AND a.s = f.s AND a.c = f.c JOIN means r ON r.entity = f.entity AND r.s = f.s AND r.c = f.s WHERE abs(a.disorder - r.disorder) <= 0.15e0 AND abs({_st(_part('f.c', 'f.n').replace('substr(t', 'substr(f.t'))} - {_st(_part('f.s', 'f.n').replace('substr(t', 'substr(f.t'))}) <= 0.10e0)
SELECT entity, s AS region_start, e AS region_end, CAST(c AS BIGINT) AS control_start, CAST(c + n - 1 AS BIGINT) AS control_end, m AS controls FROM judged WHERE k = CAST(floor(m / 2e0) AS BIGINT) + 1""",
        # Shares in three windows around each site; sites of texts under 10 symbols have none.
        "legacy_features": f"WITH {spots} SELECT entity, pos, {', '.join(legacy)} FROM (SELECT entity, pos, {segments} FROM spots) w",
        # Charge decoration of 25 symbols on each side, as pairs of charged symbols of one window.
        "legacy_scd": f"WITH {spots}, around AS (SELECT entity, pos, substr(t, CAST(greatest(1, pos - 25) AS INTEGER), CAST(least(pos + 25, len) - greatest(1, pos - 25) + 1 AS INTEGER)) AS w FROM spots), one AS (SELECT entity, pos, w, CAST(i AS BIGINT) AS i, {charge('substr(w, CAST(i AS INTEGER), 1)')} AS q FROM (SELECT entity, pos, w, EACH((1, length(w))) AS i FROM around) x), p AS (SELECT a.entity, a.pos, sum(a.q * b.q * sqrt(b.i - a.i)) AS total FROM one a JOIN one b ON a.entity = b.entity AND a.pos = b.pos AND a.i < b.i WHERE a.q <> 0 AND b.q <> 0 GROUP BY a.entity, a.pos) SELECT around.entity, around.pos, round(coalesce(total, 0) / length(w), 6) AS scd FROM around LEFT JOIN p ON p.entity = around.entity AND p.pos = around.pos",
        # Pairs of reduced classes three symbols apart, 15 symbols on each side; pairs that don't occur have no row.
        "legacy_pairs": f"WITH {spots}, around AS (SELECT entity, pos, translate(substr(t, CAST(greatest(1, pos - 15) AS INTEGER), CAST(least(pos + 15, len) - greatest(1, pos - 15) + 1 AS INTEGER)), '{members}', '{classes}') AS w, substr(t, CAST(greatest(1, pos - 15) AS INTEGER), CAST(least(pos + 15, len) - greatest(1, pos - 15) + 1 AS INTEGER)) AS raw FROM spots), two AS (SELECT entity, pos, concat(substr(w, CAST(i AS INTEGER), 1), substr(w, CAST(i + 3 AS INTEGER), 1)) AS pair FROM (SELECT entity, pos, w, raw, EACH((1, length(w) - 3)) AS i FROM around WHERE length(w) > 3) x WHERE strpos('{members}', substr(raw, CAST(i AS INTEGER), 1)) > 0 AND strpos('{members}', substr(raw, CAST(i + 3 AS INTEGER), 1)) > 0), n AS (SELECT entity, pos, pair, count(*) AS n FROM two GROUP BY entity, pos, pair) SELECT entity, pos, pair, round(n / (1e0 * sum(n) OVER (PARTITION BY entity, pos)), 9) AS share FROM n".replace("strpos(", "instr("),
        "legacy_disorder": f"WITH {spots}, v AS (SELECT entity, pos + 1 AS pos, avg(value) / 100e0 AS value FROM {{hours}} h GROUP BY entity, pos), w AS (SELECT entity, pos, avg(value) OVER (PARTITION BY entity ORDER BY pos RANGE BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS d FROM v) SELECT x.entity, x.pos, round(w.d, 9) AS disorder FROM spots x LEFT JOIN w ON w.entity = x.entity AND w.pos = x.pos",
        # Families of marks: the mean of their deltas, and means weighted by sites.
        "family_deltas": "WITH d AS (SELECT entity, mark, avg(CASE WHEN pos < 360 THEN value END) - avg(CASE WHEN pos >= 360 THEN value END) AS delta, count(*) AS n FROM {hours} h GROUP BY entity, mark) SELECT CASE WHEN mark IN ('purchase', 'signup') THEN 'outcome' ELSE 'activity' END AS family, count(delta) AS n, round(avg(delta), 6) AS mean_delta, round(sum(delta * n) / sum(CASE WHEN delta IS NOT NULL THEN n END), 6) AS weighted_delta FROM d GROUP BY CASE WHEN mark IN ('purchase', 'signup') THEN 'outcome' ELSE 'activity' END",
        # Effects that differ from zero by rounding only are zero.
        "snapped_effects": f"WITH {fractions} SELECT entity, mark, round(CASE WHEN abs(obs - nul) < 1e-12 THEN 0e0 ELSE obs - nul END, 9) AS effect FROM eff",
        # A sum in global order of keys, so that shards don't change it: values are summed as whole thousandths.
        "ordered_sums": "SELECT o_custkey % 16 AS shard, CAST(sum(CAST(round(o_totalprice * 1000) AS BIGINT)) AS BIGINT) AS thousandths FROM orders GROUP BY o_custkey % 16",
        # Spans of chains on several gaps, for each mark as a species of its own.
        "species_spans": f"WITH {sites}, f AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY entity, mark ORDER BY pos) <= 5 THEN 0 ELSE 1 END AS f FROM sites WHERE mark <> 'purchase'), k AS (SELECT *, sum(f) OVER (PARTITION BY entity, mark ORDER BY pos) AS k FROM f), core AS (SELECT entity, mark, pos FROM (SELECT *, count(*) OVER (PARTITION BY entity, mark, k) AS n FROM k) t WHERE n >= 3), f2 AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY entity, mark ORDER BY pos) <= 10 THEN 0 ELSE 1 END AS f FROM core), k2 AS (SELECT *, sum(f) OVER (PARTITION BY entity, mark ORDER BY pos) AS k FROM f2) SELECT mark, entity, min(pos) AS span_start, max(pos) AS span_end FROM k2 GROUP BY mark, entity, k HAVING count(*) >= 3",
        # Tiles of texts that are not English, with the source as gene; labelled where the centre is in a span of the document's user.
        "species_tiles": f"WITH {chain}, spans AS (SELECT entity, s + 1 AS s, e + 1 AS e, EACH((CAST(floor((s + 1) / {_BUCKET}e0) AS BIGINT), CAST(floor((e + 1) / {_BUCKET}e0) AS BIGINT))) AS b FROM islands WHERE mark = 'view'), t AS (SELECT lang, doc_id, source, CAST(c AS BIGINT) AS center, CAST(floor(c / {_BUCKET}e0) AS BIGINT) AS b FROM (SELECT lang, doc_id, source, EACH((26, length(text) - 25, 10)) AS c FROM documents WHERE lang <> 'en' AND length(text) >= 51) x) SELECT t.lang AS species, t.source AS gene, t.doc_id, t.center, max(CASE WHEN p.s IS NULL THEN 0 ELSE 1 END) AS label FROM t LEFT JOIN spans p ON p.entity = t.doc_id AND p.b = t.b AND t.center BETWEEN p.s AND p.e GROUP BY t.lang, t.source, t.doc_id, t.center",
        # Boxes: quartiles, and the outermost values within one and a half of their distance.
        "box_summary": "WITH q AS (SELECT event_type, percentile_cont(0.25) WITHIN GROUP (ORDER BY value) AS a, percentile_cont(0.5) WITHIN GROUP (ORDER BY value) AS b, percentile_cont(0.75) WITHIN GROUP (ORDER BY value) AS c FROM events GROUP BY event_type) SELECT q.event_type, round(a, 6) AS q1, round(b, 6) AS middle, round(c, 6) AS q3, min(CASE WHEN value >= a - 1.5e0 * (c - a) THEN value END) AS low, max(CASE WHEN value <= c + 1.5e0 * (c - a) THEN value END) AS high, count(CASE WHEN value < a - 1.5e0 * (c - a) OR value > c + 1.5e0 * (c - a) THEN 1 END) AS outside FROM events v JOIN q ON q.event_type = v.event_type GROUP BY q.event_type, a, b, c",
        # Only numbers count: neither null nor NaN nor infinite.
        "finite_values": "SELECT event_type, count(*) AS n, round(sum(x), 6) AS total FROM (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 7 = 1 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 7 = 2 THEN NULL ELSE value END AS x FROM events) t WHERE x IS NOT NULL AND NOT isnan(x) AND abs(x) < CAST('Infinity' AS DOUBLE) GROUP BY event_type",
        "group_by_all": "SELECT mark, entity % 4 AS shard, count(*) AS n FROM {hours} h GROUP BY ALL",
    }
