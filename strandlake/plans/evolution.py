"""Queries over alignments with gaps, which Spark makes of the documents by a rule, writes as FASTA and reads again.

A document's letters are the main row; its mouse and fly rows have letters changed, left out and (mouse) put in at places that the
rule gives. Users' events are the sites of the document with the same number, an hour being a position; those of the next user are the mouse row's sites,
those of the one after it the fly row's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import alignments, intervals, search
from strandlake.operators.alignments import CATEGORIES, LEAST, LETTERS, MEASURES, STICKY
from strandlake.plans.base import hours, sites, table
from strandlake.sources import files

_RECORD = pa.schema([(c, pa.string()) for c in ("accession", "id", "sequence")])
_CAPITALS, _TURNED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "EFGHIJKLMNOPQRSTUVWXYZABCD"
#: A gap of two columns follows each run of so many main letters; the mouse row has SG there.
_RUN = 37
#: taxon: every so many positions two letters are missing, every so many others are turned, whose sites are so many users on, what stands in the main row's gaps.
_TAXA = {"mouse": (29, 11, 1, "SG"), "fly": (17, 5, 2, "--")}
#: Groups of taxa by how long ago they parted.
_RUNGS = {"near": ("mouse",), "all": ("mouse", "fly")}


#: Small letters become capitals; all that is no letter of ASCII goes.
_TO_CAPITALS = bytes(range(256)).upper()
_NO_LETTERS = bytes(i for i in range(256) if not (i < 128 and chr(i).isalpha()))


def capitals(text: str) -> bytes:
    """The letters of ASCII in a text, as capitals."""
    return text.encode("utf-8").translate(_TO_CAPITALS, _NO_LETTERS)


def letters(docs: DataFrame) -> DataFrame:
    """(entity, s): the documents' letters; null texts stay."""

    def run(batches):
        for b in batches:
            made = [None if t is None else capitals(t).decode("ascii") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, pa.string())], names=["entity", "s"])

    return docs.select("doc_id", "text").mapInArrow(run, f"entity {docs.schema['doc_id'].dataType.simpleString()}, s string")


def rows_of(own: np.ndarray, doc_id: int) -> list[str]:
    """The main, mouse and fly rows of a sequence of capitals."""
    at = np.arange(1, len(own) + 1)
    column = at - 1 + 2 * ((at - 1) // _RUN)
    width = len(own) + 2 * (len(own) // _RUN)
    between = [_RUN + (_RUN + 2) * np.arange(len(own) // _RUN) + k for k in (0, 1)]

    def spread(letters: np.ndarray, put: str) -> str:
        row = np.empty(width, np.uint8)
        row[column] = letters
        for k in (0, 1):
            row[between[k]] = ord(put[k])
        return row.tobytes().decode("ascii")

    out = [spread(own, "--")]
    for missing, turned, _, put in _TAXA.values():
        letters = np.where((at * 7 + doc_id) % turned == 0, (own - 65 + 4) % 26 + 65, own)
        out.append(spread(np.where(at % missing < 2, ord("-"), letters), put))
    return out


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(accession, taxon, member, sequence, main_sequence), written as FASTA and read again."""

    def made(batches):
        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                s = np.frombuffer(capitals(text), np.uint8)
                if not len(s):
                    continue
                ids = ["human", *(f"{taxon}_{i + on}" for taxon, (_, _, on, _) in _TAXA.items())]
                yield pa.RecordBatch.from_pydict({"accession": [str(i)] * len(ids), "id": ids, "sequence": rows_of(s, i)}, schema=_RECORD)

    path = files.new_path(spark, "aligned")
    alignments.write_aligned(table(spark, sf_dir, "documents").select("doc_id", "text").dropna().mapInArrow(made, "accession string, id string, sequence string"), path)
    return files.read_alignments(spark, path, list(_TAXA), packed=True)


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites(spark, sf_dir).where("mark = 'purchase'").select(F.col("entity").cast("string").alias("accession"), (F.col("pos") + 1).alias("pos"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = intervals.islands(sites(spark, sf_dir).where("mark = 'purchase'"), ["entity", "mark"], "pos", 24, 3)
    return made.select(F.col("entity").cast("string").alias("accession"), (F.col("start") + 1).alias("start"), (F.col("end") + 1).alias("end"))


def align_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of each pair: how many keep S or T, and how many have one within five positions."""
    made = alignments.site_conservation(pairs(spark, sf_dir), _sites(spark, sf_dir))
    return made.groupBy("accession", "taxon").agg(F.count("*").alias("n_sites"), F.count_if("exact").alias("n_exact"), F.count_if("regional").alias("n_near"))


def species_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all of a taxon's sites."""
    made = alignments.site_conservation(pairs(spark, sf_dir), _sites(spark, sf_dir))
    share = lambda c: F.avg(F.col(c).cast("double"))
    return made.groupBy("taxon").agg(F.round(share("exact"), 9).alias("exact"), F.round(share("regional"), 9).alias("regional"), F.round(share("regional") - share("exact"), 9).alias("gap"), F.count("*").alias("n_sites"), F.count_distinct("accession").alias("n_entities"))


def substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes away from letters that don't bind, and gains of such that do, in regions and in windows of the same size half a sequence on, by group of taxa."""
    spans = _regions(spark, sf_dir)
    size = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("accession"), F.length(F.regexp_replace(F.translate("text", _CAPITALS.lower(), _CAPITALS), "[^A-Z]", "")).cast("long").alias("len"))
    width = F.col("end") - F.col("start") + 1
    both = spans.join(size, "accession").where("end <= len").withColumn("control", 1 + F.pmod(F.col("start") - 1 + F.floor(F.col("len") / 2), F.col("len") - width + 1))
    windows = both.select("accession", F.lit("region").alias("arm"), "start", "end").union(both.select("accession", F.lit("control"), "control", F.col("control") + width - 1))
    made = alignments.substitutions(pairs(spark, sf_dir), windows)
    rungs = F.explode(F.array(*(F.lit(r) for r in _RUNGS)))
    kept = made.withColumn("rung", rungs).where(" OR ".join(f"rung = '{r}' AND taxon IN ({', '.join(map(repr, t))})" for r, t in _RUNGS.items()))
    return kept.groupBy("rung", "arm").agg(F.count("*").alias("n_windows"), F.sum("n_changes").alias("n_changes"), F.sum("n_gain").alias("n_gain"), F.round(F.try_divide(F.sum("n_gain"), F.sum("n_changes")), 9).alias("rate"))


def category_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = alignments.category_identity(pairs(spark, sf_dir))
    return made.select("accession", "taxon", "n_columns", *(F.round(c, 9).alias(c) for c in CATEGORIES))


def window_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region and pair: how alike they are, and by how much more than windows elsewhere."""
    own = _sites(spark, sf_dir)
    other = own.withColumnRenamed("accession", "member")
    made = alignments.window_nulls(pairs(spark, sf_dir), _regions(spark, sf_dir), own, other, buckets=None)
    return made.select("accession", "taxon", "start", "n_columns", *(F.round(m, 9).alias(m) for m in MEASURES))


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents' letters, and for each event a peptide of 3 to 12 letters of the user's document that begins up to six letters before the event's position."""
    docs = letters(table(spark, sf_dir, "documents"))
    found = hours(table(spark, sf_dir, "events")).select("entity", (F.col("pos") + 1).alias("site"), "event_id").join(docs, "entity").where("site <= length(s)")
    start = F.greatest(F.col("site") - F.col("event_id") % 7, F.lit(1))
    return docs, found.select("entity", "site", F.substr("s", start.cast("int"), (3 + F.col("event_id") % 10).cast("int")).alias("peptide"))


def substring_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of each site's peptides, overlapping ones too, that contain the site."""
    docs, evidence = _evidence(spark, sf_dir)
    made = search.spans_of_sites(docs, evidence, "entity", "s", "site", "peptide")
    return made.select("entity", "site", F.col("pattern").alias("peptide"), "span_start", "span_end")


def peptide_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each peptide stands in any document, and in how many."""
    docs, evidence = _evidence(spark, sf_dir)
    made = search.counts(spark, docs, evidence, "entity", "s", "peptide")
    return made.select(F.col("pattern").alias("peptide"), "n_places", F.col("n_sequences").alias("n_documents"), "total")


_SEQS = f"seqs AS (SELECT doc_id, regexp_replace(translate(text, '{_CAPITALS.lower()}', '{_CAPITALS}'), '[^A-Z]', '', 'g') AS s FROM documents), chars AS (SELECT doc_id, generate_subscripts(l, 1) AS p, unnest(l) AS c FROM (SELECT doc_id, regexp_extract_all(s, '.') AS l FROM seqs WHERE s <> '') q)"
# A row for each position of a pair, with its column; and cells, with the columns between.
_OTHER = (
    "taxa(taxon, missing, turned, shift, put) AS (VALUES " + ", ".join(f"('{t}', {m}, {c}, {on}, '{put}')" for t, (m, c, on, put) in _TAXA.items()) + "), "
    f"other AS (SELECT doc_id, taxon, p, p - 1 + 2 * ((p - 1) // {_RUN}) AS col, c, shift, put, CASE WHEN p % missing < 2 THEN '-' WHEN (p * 7 + doc_id) % turned = 0 THEN translate(c, '{_CAPITALS}', '{_TURNED}') ELSE c END AS o FROM chars CROSS JOIN taxa), "
    f"cells AS (SELECT doc_id, taxon, shift, col, p, c, o FROM other UNION ALL SELECT doc_id, taxon, shift, col + k, NULL, '-', put[k] FROM other CROSS JOIN (SELECT unnest([1, 2]) AS k) WHERE p % {_RUN} = 0)"
)
_SITES = "site AS (SELECT DISTINCT user_id AS doc_id, CAST(floor((floor(epoch(ts)) - 1704067200) / 3600) AS BIGINT) + 1 AS p FROM events WHERE event_type = 'purchase')"
_REGIONS = f"{_SITES}, flagged AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 24 THEN 0 ELSE 1 END AS f FROM site), chain AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM flagged), region AS (SELECT doc_id, min(p) AS s, max(p) AS e FROM chain GROUP BY doc_id, k HAVING count(*) >= 3)"
_KEPT = f"WITH {_SEQS}, {_OTHER}, {_SITES}, near AS (SELECT *, max(CASE WHEN o IN ('S', 'T') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, taxon ORDER BY p ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM other), k AS (SELECT n.doc_id, n.taxon, n.o IN ('S', 'T') AS exact, near FROM near n JOIN site USING (doc_id, p))"
_IN = lambda letters: "(" + ", ".join(repr(x) for x in letters) + ")"
_SUBSTITUTIONS = f"""WITH {_SEQS}, {_OTHER}, {_REGIONS},
gaps AS (SELECT *, max(CASE WHEN o = '-' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, taxon ORDER BY col ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS gap FROM cells),
changes AS (SELECT doc_id, taxon, p, CASE WHEN o IN {_IN(STICKY)} THEN 1 ELSE 0 END AS gain FROM gaps WHERE p IS NOT NULL AND gap = 0 AND c <> o AND c NOT IN {_IN(STICKY)}),
both_ AS (SELECT r.doc_id, s, e, 1 + (s - 1 + length(q.s) // 2) % (length(q.s) - (e - r.s + 1) + 1) AS b FROM (SELECT doc_id, s, e FROM region) r JOIN (SELECT doc_id, s FROM seqs) q USING (doc_id) WHERE e <= length(q.s)),
wins AS (SELECT doc_id, 'region' AS arm, s AS a, e AS z FROM both_ UNION ALL SELECT doc_id, 'control', b, b + e - s FROM both_),
rungs(rung, taxon) AS (VALUES {', '.join(f"('{r}', '{t}')" for r, ts in _RUNGS.items() for t in ts)}),
counted AS (SELECT w.doc_id, w.arm, w.a, t.taxon, count(c.p) AS n, coalesce(sum(gain), 0) AS g FROM wins w CROSS JOIN taxa t LEFT JOIN changes c ON c.doc_id = w.doc_id AND c.taxon = t.taxon AND c.p BETWEEN w.a AND w.z GROUP BY ALL)
SELECT rung, arm, count(*) AS n_windows, sum(n)::BIGINT AS n_changes, sum(g)::BIGINT AS n_gain, round(sum(g) / nullif(sum(n), 0), 9) AS rate FROM counted JOIN rungs USING (taxon) GROUP BY rung, arm""".replace("r.doc_id, s, e, 1 + (s - 1", "r.doc_id, r.s AS s, e, 1 + (r.s - 1")
_HEX8 = lambda text: f"('0x' || substr(md5({text}), 1, 8))::BIGINT"
_HEX15 = lambda text: f"('0x' || substr(md5({text}), 1, 15))::BIGINT"
_FOUR = ("pearson", "cosine", "js", "position")


def _alike(a: str, b: str) -> str:
    """Correlation, cosine and 1 - Jensen-Shannon of the letter counts of two texts, as columns c_, k_ and j_ of a lateral row."""
    letters = f"unnest({list(LETTERS)!r}) AS x"
    return (
        f"(SELECT corr(u, v) AS pearson, sum(u * v) / nullif(sqrt(sum(u * u) * sum(v * v)), 0) AS cosine, 1 - sum(CASE WHEN u > 0 THEN u / su * log2(u / su / ((u / su + v / sv) / 2)) ELSE 0 END + CASE WHEN v > 0 THEN v / sv * log2(v / sv / ((u / su + v / sv) / 2)) ELSE 0 END) / 2 AS js "
        f"FROM (SELECT u, v, nullif(sum(u) OVER (), 0) AS su, nullif(sum(v) OVER (), 0) AS sv FROM (SELECT (length({a}) - length(replace({a}, x, '')))::DOUBLE AS u, (length({b}) - length(replace({b}, x, '')))::DOUBLE AS v FROM (SELECT {letters}))))"
    )


def _position(a: str, b: str) -> str:
    return f"(SELECT corr(u, v) FROM (SELECT unnest(string_split({a}, ''))::DOUBLE AS u, unnest(string_split({b}, ''))::DOUBLE AS v))"


_CONCAT = lambda x, order: f"string_agg({x}, '' ORDER BY {order})"
_WINDOW_NULL = f"""WITH {_SEQS}, {_OTHER}, {_REGIONS},
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, taxon ORDER BY col) AS place FROM cells WHERE o <> '-'),
whole AS (SELECT doc_id, taxon, any_value(shift) AS shift, {_CONCAT('o', 'col')} AS t FROM placed GROUP BY doc_id, taxon),
has AS (SELECT w.doc_id, w.taxon, list(p) AS found FROM whole w JOIN site ON site.doc_id = w.doc_id + w.shift GROUP BY ALL),
cut AS (SELECT r.doc_id, x.taxon, r.s, r.e, count(*) AS n, min(place) AS a, max(place) AS z, {_CONCAT('o', 'x.p')} AS same, {_CONCAT("CASE WHEN m.p IS NULL THEN '0' ELSE '1' END", 'x.p')} AS own_sites, {_CONCAT("CASE WHEN list_contains(h.found, place) THEN '1' ELSE '0' END", 'x.p')} AS same_sites
  FROM region r JOIN placed x ON x.doc_id = r.doc_id AND x.p BETWEEN r.s AND r.e JOIN has h ON h.doc_id = x.doc_id AND h.taxon = x.taxon LEFT JOIN site m ON m.doc_id = x.doc_id AND m.p = x.p GROUP BY r.doc_id, x.taxon, r.s, r.e HAVING count(*) >= 8),
cut2 AS (SELECT c.*, substr(q.s, c.s, c.e - c.s + 1) AS own, w.t FROM cut c JOIN seqs q ON q.doc_id = c.doc_id JOIN whole w ON w.doc_id = c.doc_id AND w.taxon = c.taxon),
tries AS (SELECT doc_id, taxon, s, n, a, z, trial, 1 + {_HEX8("doc_id || ':' || taxon || ':' || s || ':' || trial")} % (length(t) - n) AS b FROM cut2 CROSS JOIN (SELECT unnest(range(1, 41)) AS trial) WHERE length(t) > n + 20),
near AS (SELECT doc_id, taxon, s, arg_min(b, trial) AS b FROM tries WHERE b + n - 1 < a - 10 OR b > z + 10 GROUP BY doc_id, taxon, s),
pool AS (SELECT taxon, row_number() OVER (PARTITION BY taxon ORDER BY md5(doc_id::VARCHAR), doc_id::VARCHAR) - 1 AS number, count(*) OVER (PARTITION BY taxon) AS total, t AS u FROM whole WHERE length(t) >= {LEAST}),
far AS (SELECT d.doc_id, d.taxon, d.s, arg_min(substr(u, 1 + {_HEX8("'begin:' || d.doc_id || ':' || d.taxon || ':' || d.s || ':' || trial")} % (length(u) - n), n), trial) AS far FROM (SELECT c.doc_id, c.taxon, c.s, c.n, trial, {_HEX15("'far:' || c.doc_id || ':' || c.taxon || ':' || c.s || ':' || trial")} % total AS number FROM cut2 c JOIN (SELECT DISTINCT taxon, total FROM pool) USING (taxon) CROSS JOIN (SELECT unnest(range(1, 21)) AS trial)) d JOIN pool p ON p.taxon = d.taxon AND p.number = d.number WHERE length(u) > n + 5 GROUP BY ALL),
three AS (SELECT c.doc_id, c.taxon, c.s, c.n, c.own, c.same, c.own_sites, c.same_sites, f.far, substr(c.t, x.b, c.n) AS near, array_to_string(list_transform(range(x.b, x.b + c.n), lambda i: CASE WHEN list_contains(h.found, i) THEN '1' ELSE '0' END), '') AS near_sites
  FROM cut2 c JOIN has h ON h.doc_id = c.doc_id AND h.taxon = c.taxon LEFT JOIN near x ON x.doc_id = c.doc_id AND x.taxon = c.taxon AND x.s = c.s LEFT JOIN far f ON f.doc_id = c.doc_id AND f.taxon = c.taxon AND f.s = c.s),
m AS (SELECT t.doc_id, t.taxon, t.s, t.n, a.pearson AS true_pearson, a.cosine AS true_cosine, a.js AS true_js, {_position('own_sites', 'same_sites')} AS true_position,
  CASE WHEN near IS NOT NULL THEN b.pearson END AS null_a_pearson, CASE WHEN near IS NOT NULL THEN b.cosine END AS null_a_cosine, CASE WHEN near IS NOT NULL THEN b.js END AS null_a_js, CASE WHEN near IS NOT NULL THEN {_position('own_sites', 'near_sites')} END AS null_a_position,
  CASE WHEN far IS NOT NULL THEN d.pearson END AS null_b_pearson, CASE WHEN far IS NOT NULL THEN d.cosine END AS null_b_cosine, CASE WHEN far IS NOT NULL THEN d.js END AS null_b_js FROM three t, LATERAL {_alike('own', 'same')} a, LATERAL {_alike('own', 'near')} b, LATERAL {_alike('own', 'far')} d),
clean AS (SELECT * REPLACE ({', '.join(f'CASE WHEN isnan({x}) THEN NULL ELSE {x} END AS {x}' for x in [*(f'true_{k}' for k in _FOUR), *(f'null_a_{k}' for k in _FOUR), *(f'null_b_{k}' for k in _FOUR[:3])])}) FROM m)
SELECT doc_id::VARCHAR AS accession, taxon, s AS start, n AS n_columns, {', '.join(f'round({x}, 9) AS {x}' for x in [*(f'true_{k}' for k in _FOUR), *(f'null_a_{k}' for k in _FOUR), *(f'null_b_{k}' for k in _FOUR[:3])])}, {', '.join(f'round(true_{k} - null_a_{k}, 9) AS excess_a_{k}' for k in _FOUR)}, {', '.join(f'round(true_{k} - null_b_{k}, 9) AS excess_b_{k}' for k in _FOUR[:3])} FROM clean"""

_PEPTIDES = f"WITH {_SEQS}, pep AS (SELECT entity, site, substr(s, greatest(site - event_id % 7, 1), 3 + event_id % 10) AS peptide FROM (SELECT user_id AS entity, event_id, CAST(floor((floor(epoch(ts)) - 1704067200) / 3600) AS BIGINT) + 1 AS site FROM events) e JOIN seqs ON doc_id = entity WHERE site <= length(s))"

QUERIES = {
    align_conservation: _KEPT + " SELECT doc_id::VARCHAR AS accession, taxon, count(*) AS n_sites, count(*) FILTER (WHERE exact) AS n_exact, sum(near)::BIGINT AS n_near FROM k GROUP BY doc_id, taxon",
    species_conservation: _KEPT + " SELECT taxon, round(avg(exact::INTEGER), 9) AS exact, round(avg(near), 9) AS regional, round(avg(near) - avg(exact::INTEGER), 9) AS gap, count(*) AS n_sites, count(DISTINCT doc_id) AS n_entities FROM k GROUP BY taxon",
    substitutions: _SUBSTITUTIONS,
    category_identity: f"WITH {_SEQS}, {_OTHER} SELECT doc_id::VARCHAR AS accession, taxon, count(*) FILTER (WHERE o <> '-') AS n_columns, " + ", ".join(f"round(avg((c = o)::INTEGER) FILTER (WHERE o <> '-' AND c IN {_IN(letters)}), 9) AS {name}" for name, letters in CATEGORIES.items()) + " FROM other GROUP BY doc_id, taxon",
    window_null: _WINDOW_NULL,
    substring_spans: _PEPTIDES + " SELECT DISTINCT p.entity, site, peptide, c.p::BIGINT AS span_start, (c.p + length(peptide) - 1)::BIGINT AS span_end FROM pep p JOIN chars c ON c.doc_id = p.entity AND c.p BETWEEN site - length(peptide) + 1 AND site JOIN seqs q ON q.doc_id = p.entity WHERE substr(q.s, c.p, length(peptide)) = peptide",
    peptide_search: _PEPTIDES + ", lead AS (SELECT doc_id, p, " + " || ".join(["c", *(f"coalesce(lead(c, {k}) OVER w, '')" for k in range(1, 12))]) + " AS twelve FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY p)), t AS (SELECT DISTINCT peptide FROM pep) SELECT peptide, count(*) AS n_places, count(DISTINCT doc_id) AS n_documents, sum(p)::BIGINT AS total FROM (SELECT doc_id, p, left(twelve, k) AS peptide FROM lead CROSS JOIN (SELECT unnest(range(1, 13)) AS k) WHERE length(twelve) >= k) l JOIN t USING (peptide) GROUP BY peptide",
}
