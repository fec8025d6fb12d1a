"""Substring dedup by sliding sentence spans: runs of consecutive sentences that repeat anywhere are removed but for the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm._store import save

#: Words of a run. A shared passage of 50 words or more holds whole sentences of about as many; shared phrases and stock lines have fewer.
MIN_WORDS = 20
#: Scripts without spaces between words: two characters count as a word.
_UNSPACED = r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]+"
#: Stands for a null id: such rows come last.
_LAST = 9223372036854775807


def with_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text in 32 bits, by which rows with one id are told apart) and sentences: a text is parted after . ! or ? before white space, after their full-width forms, and at line ends; blank pieces go."""
    parts = F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+|(?<=[。！？])\s*|[\n\r]+")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("h"), F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "").alias("sentences"))


def n_words(s):
    """Words of a sentence, which has single spaces."""
    spaces = F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    unspaced = F.when(F.octet_length(s) != F.length(s), F.floor(F.length(F.regexp_replace(s, _UNSPACED, "")) / 2)).otherwise(0)
    return (spaces + 1 + unspaced).cast("int")


def runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, h, at, size, key, tag): runs of sentences by a 96-bit hash. From each sentence on, and back from each, the shortest run with min_words words.

    Within a longer stretch that two documents share, the runs that begin or end inside it cover all of its sentences.
    """

    # Each step is bound to a name by a transform of one element: a plain column would be worked out anew for each element of the next step.
    let = "flatten(transform(array({value}), {name} -> {body}))"
    # Words up to each sentence: sums within pieces of 64 sentences, and of the pieces before. Each sentence has a word, so that a run has at most min_words sentences.
    pieces = "transform(sequence(0, (size(r) - 1) div 64), c -> aggregate(slice(r, CAST(c * 64 + 1 AS int), 64), CAST(array() AS array<int>), (done, x) -> concat(done, array(coalesce(get(done, size(done) - 1), 0) + x.n))))"
    before = "aggregate(p, array(0), (done, q) -> concat(done, array(get(done, size(done) - 1) + get(q, size(q) - 1))))"
    upto = "concat(array(0), flatten(transform(p, (q, j) -> transform(q, x -> x + get(b, j)))))"
    on = " ".join(f"WHEN get(u, i + {k}) - get(u, i) >= {min_words} THEN {k}" for k in range(1, min_words + 1))
    back = " ".join(f"WHEN get(u, i + 1) - get(u, i + 1 - {k}) >= {min_words} THEN {k}" for k in range(1, min_words + 1))
    # A run back is left out where it is the run on from its first sentence.
    both = f"flatten(transform(r, (x, i) -> array(named_struct('at', i, 'size', CASE {on} END), transform(array(CASE {back} END), k -> named_struct('at', i + 1 - k, 'size', CASE WHEN get(u, i) - get(u, i + 1 - k) >= {min_words} THEN k END))[0])))"
    spans = f"filter({both}, x -> x.size IS NOT NULL)"
    found = f"transform({spans}, x -> named_struct('at', x.at, 'size', x.size, 'key', xxhash64(slice(r, x.at + 1, x.size).key), 'tag', hash(slice(r, x.at + 1, x.size).tag)))"
    for name, value in (("u", upto), ("b", before), ("p", pieces), ("r", "rows")):
        found = let.format(value=value, name=name, body=found)
    rows = F.transform("sentences", lambda s: F.struct(n_words(s).alias("n"), F.xxhash64(s).alias("key"), F.hash(s).alias("tag")))
    made = with_sentences(docs).where(F.size("sentences") > 0).select("doc_id", "h", rows.alias("rows"))
    return made.select("doc_id", "h", F.explode(F.expr(found)).alias("r")).select("doc_id", "h", "r.at", "r.size", "r.key", "r.tag")


def repeated(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, h, at, size) of each run that is not the first of its kind. First is the one with the smallest doc_id, then hash of its text, then place; a null id comes last.

    Counts are made by partial aggregation before the shuffle, so that a run in a third of all documents is one row for each
    task; repeated runs are written before they are joined, so that Spark can split a frequent one.
    """
    place = F.coalesce("doc_id", F.lit(_LAST))
    all_runs = save(spark, runs(docs, min_words), "hashed")
    known = save(spark, all_runs.groupBy("key", "tag").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "tag", "first"), "repeats")
    hits = save(spark, all_runs.join(known, ["key", "tag"]), "runs")
    own = hits.where(place == F.col("first")).groupBy("key", "tag").agg(F.min(F.struct("h", "at")).alias("begin"))
    later = hits.where(place > F.col("first")).select("doc_id", "h", "at", "size")
    return later.union(hits.where(place == F.col("first")).join(own, ["key", "tag"]).where(F.struct("h", "at") > F.col("begin")).select("doc_id", "h", "at", "size"))


def removed(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, h, removed): the indices, in order, of the sentences that repeated runs cover; documents that lose none have no row.

    Null and empty texts have no sentences. Rows that repeat both id and text are one document; with different texts they are judged apart, by h.
    """
    covered = repeated(spark, docs, min_words).groupBy("doc_id", "h").agg(F.collect_set(F.struct("at", "size")).alias("runs"))
    return covered.select("doc_id", "h", F.expr("array_sort(array_distinct(flatten(transform(runs, r -> sequence(r.at, r.at + r.size - 1)))))").alias("removed"))


def dedup(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_sentences, n_removed, removed, text) of the rows that lose sentences, rows with a null id too; text is what stays, a sentence a line."""
    gone = removed(spark, docs, min_words).toDF("id_", "h_", "removed")
    rows = with_sentences(docs)
    joined = rows.join(gone, rows["doc_id"].eqNullSafe(gone["id_"]) & (rows["h"] == gone["h_"]))
    kept = F.array_except(F.sequence(F.lit(0), F.size("sentences") - 1), "removed")
    left = F.transform(kept, lambda i: F.get("sentences", i))
    return joined.select("doc_id", F.size("sentences").alias("n_sentences"), F.size("removed").alias("n_removed"), "removed", F.array_join(left, "\n").alias("text"))


#: The rows of removed() in DuckDB, with `removed` as text. Row identity is id and text, runs are compared as texts.
SQL = f"""WITH parts AS (SELECT doc_id, text AS t, unnest(string_split_regex(regexp_replace(regexp_replace(text, '([.!?])[\\t\\n\\x0B\\f\\r ]+', '\\1' || chr(10), 'g'), '([\\x{{3002}}\\x{{ff01}}\\x{{ff1f}}])[\\t\\n\\x0B\\f\\r ]*', '\\1' || chr(10), 'g'), '[\\n\\r]+')) AS s, generate_subscripts(string_split_regex(regexp_replace(regexp_replace(text, '([.!?])[\\t\\n\\x0B\\f\\r ]+', '\\1' || chr(10), 'g'), '([\\x{{3002}}\\x{{ff01}}\\x{{ff1f}}])[\\t\\n\\x0B\\f\\r ]*', '\\1' || chr(10), 'g'), '[\\n\\r]+'), 1) AS p FROM (SELECT DISTINCT doc_id, text FROM documents) d),
sentences AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id, t ORDER BY p) - 1 AS i, s FROM (SELECT doc_id, t, p, trim(regexp_replace(s, '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g'), ' ') AS s FROM parts) x WHERE s <> ''),
counted AS (SELECT *, sum(length(s) - length(replace(s, ' ', '')) + 1 + CASE WHEN strlen(s) <> length(s) THEN length(regexp_replace(s, '[^\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Thai}}\\p{{Lao}}\\p{{Khmer}}\\p{{Myanmar}}]', '', 'g')) // 2 ELSE 0 END) OVER (PARTITION BY doc_id, t ORDER BY i) AS upto FROM sentences),
bounds AS (SELECT a.doc_id, a.t, a.i AS a, b.i AS b, b.upto - a.upto + (a.upto - coalesce(z.upto, 0)) AS n, b.upto - coalesce(b2.upto, 0) AS last_n, a.upto - coalesce(z.upto, 0) AS first_n FROM counted a JOIN counted b ON a.doc_id = b.doc_id AND a.t = b.t AND b.i BETWEEN a.i AND a.i + {MIN_WORDS - 1} LEFT JOIN counted z ON z.doc_id = a.doc_id AND z.t = a.t AND z.i = a.i - 1 LEFT JOIN counted b2 ON b2.doc_id = b.doc_id AND b2.t = b.t AND b2.i = b.i - 1),
spans AS (SELECT doc_id, t, a, b FROM bounds WHERE n >= {MIN_WORDS} AND (n - last_n < {MIN_WORDS} OR n - first_n < {MIN_WORDS})),
texts AS (SELECT x.doc_id, x.t, x.a, x.b, string_agg(s, chr(10) ORDER BY i) AS run FROM spans x JOIN sentences s ON s.doc_id = x.doc_id AND s.t = x.t AND s.i BETWEEN x.a AND x.b GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, t, a) AS r FROM texts),
covered AS (SELECT DISTINCT doc_id, t, unnest(generate_series(a, b)) AS i FROM placed WHERE r > 1)
SELECT doc_id, count(*) AS n_removed, string_agg(i::VARCHAR, ',' ORDER BY i) AS removed FROM covered GROUP BY doc_id, t"""
