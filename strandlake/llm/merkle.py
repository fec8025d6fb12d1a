"""A Merkle manifest of a table: leaves by group, one root, and each row's proof, by pivots of slots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm._store import drop, save

#: Levels of a tree that one shuffle serves: the rows of a task's block, fanout ** LEVELS at most, hold them all.
LEVELS = 8


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value; integers in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*(encoded(v) for v in values)), 256)


def ordered(spark: SparkSession, rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows with pos, the place of each among the rows of its key by the columns of `order`, from 0, and size, how many these are.

    Rows are dealt by ranges, so that a large key is in many tasks; a row's place is that in its range and key, and what ranges
    before have of the key. Equal rows must differ in `order`, or else they share a range.
    """
    placed = save(spark, rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("key", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    of_key = Window.partitionBy("key")
    starts = parts.select("key", "part", (F.sum("n").over(of_key.orderBy("part")) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(of_key).alias("size"))
    return placed.join(starts, ["key", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _ceil(n: Column, by: int) -> Column:
    return F.floor((n + by - 1) / F.lit(by)).cast("long")


def climbed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """nodes (key, pos, size, digest, ...) with block, path and node: the siblings of each on its way up `levels` levels, and where that ends.

    At each level, conditional aggregates over a parent's rows spread its children into fanout columns: joined they are hashed,
    and without a row's own column they are its siblings. A row's digits name its ancestors, so that one shuffle by block
    and one sort by digits serve every level. A key with one node left has no more levels.
    """
    span = fanout**levels
    digit = [f"digit{k}" for k in range(levels)]
    rows = nodes.withColumn("block", F.floor(F.col("pos") / F.lit(span)).cast("long")).withColumns({d: F.pmod(F.floor(F.col("pos") / F.lit(fanout**k)).cast("long"), F.lit(fanout)).cast("int") for k, d in enumerate(digit)}).withColumn("node", F.col("digest"))
    rows = rows.repartition("key", "block").sortWithinPartitions("key", "block", *reversed(digit))
    for k, own in enumerate(digit):
        of_parent = Window.partitionBy("key", "block", *reversed(digit[k + 1 :]))
        rows = rows.withColumns({f"slot{s}": F.coalesce(F.max(F.when(F.col(own) == s, F.col("node"))).over(of_parent), F.lit("")) for s in range(fanout)})
        slots = [F.col(f"slot{s}") for s in range(fanout)]
        before = [F.when(F.col(own) > s, x).otherwise("") for s, x in enumerate(slots)]
        after = [F.when(F.col(own) < s, x).otherwise("") for s, x in enumerate(slots)]
        live = _ceil(F.col("size"), fanout**k) > 1
        rows = rows.withColumns({f"step{k}": F.when(live, F.struct(F.concat(*before).alias("left"), F.concat(*after).alias("right"))), "node": F.when(live, F.sha2(F.concat(*slots), 256)).otherwise(F.col("node"))})
    path = F.filter(F.array(*(f"step{k}" for k in range(levels))), lambda x: x.isNotNull())
    return rows.withColumn("path", path).drop(*(f"slot{s}" for s in range(fanout)), *(f"step{k}" for k in range(levels)), *digit)


def up(spark: SparkSession, nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The written tables of a tree's blocks, from the leaves up; the last one's rows at pos 0 have each key's root as node."""
    made = []
    while True:
        made.append(save(spark, climbed(nodes, fanout, levels), "merkle-blocks"))
        most = made[-1].agg(F.max("size")).first()[0] or 0
        if most <= fanout**levels:
            return made
        nodes = made[-1].where(F.col("pos") % F.lit(fanout**levels) == 0).select("key", F.col("block").alias("pos"), _ceil(F.col("size"), fanout**levels).alias("size"), F.col("node").alias("digest"))


def down(blocks: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with their whole paths; above: (key, suffix, top) goes to the last table, which has few rows of any key."""
    rows = blocks[-1].join(above.select("key", "suffix", *(c for c in above.columns if c not in ("key", "suffix"))), "key").withColumn("subroot", F.col("node"))
    for below in reversed(blocks[:-1]):
        carried = rows.select("key", F.col("pos").alias("block"), F.concat("path", "suffix").alias("suffix"), "subroot", *(c for c in above.columns if c not in ("key", "suffix")))
        rows = below.join(carried, ["key", "block"])
    return rows.withColumn("path", F.concat("path", "suffix")).drop("suffix", "block", "node")


def manifest(spark: SparkSession, leaves: DataFrame, group_col: str, order_col: str, fanout: int = 2, levels: int = LEVELS) -> DataFrame:
    """leaves (with group, order and digest) with subroot, root and path: an array of (left, right), the siblings beside each node from the leaf up.

    A group's leaves ascend by order_col (null first), then by digest; equal ones stand together in either order, which changes
    no digest. Groups ascend by value (null first, bytewise), null being a group of its own. Every `fanout` consecutive nodes, at the end
    fewer, make one, until one is left. An empty table has no rows. Other columns are kept, except those named key, pos, size,
    part, at, row, block, node, path, subroot, root, suffix, digitK, slotK or stepK.
    """
    key = F.coalesce(F.concat(F.lit("v"), F.col(group_col).cast("string")), F.lit("n"))
    named = save(spark, leaves.withColumn("key", key).withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    blocks = up(spark, ordered(spark, named, [order_col, "digest", "row"]), fanout, levels)
    roots = blocks[-1].where("pos = 0").select(F.lit("").alias("key"), F.col("key").alias("name"), F.col("node").alias("digest"))
    tops = up(spark, ordered(spark, roots, ["name"]), fanout, levels)
    none = tops[-1].where("pos = 0").select("key", F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("suffix"), F.col("node").alias("root"))
    above = down(tops, none).select(F.col("name").alias("key"), F.col("path").alias("suffix"), "root")
    return down(blocks, above).drop("key", "pos", "size", "row")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, digest, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))


def proof(path: Column) -> Column:
    """The digest of all siblings, from the leaf up and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def audit(spark: SparkSession, docs: DataFrame, fanout: int = 2, every: int = 7) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of documents, repeated rows included.

    Rows whose crc32 of the decimal id is a multiple of `every` are tampered with: 1 is added to n_chars. Nulls stay, so that such a row
    still verifies; a row with a null id is not tampered with. Any column may be null; columns besides the five are ignored.
    """
    hit = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % every == 0)
    made = docs.select("doc_id", "source", "lang", "n_chars", "text")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    rows = made.select("doc_id", "lang", leaf(fields).alias("digest"), F.when(hit, leaf([*fields[:3], more, fields[4]])).alias("tampered"))
    found = manifest(spark, rows, "lang", "doc_id", fanout)
    found = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same rows in DuckDB: a row for each leaf climbs one level a round.
SQL = """
WITH RECURSIVE given AS (
  SELECT doc_id, coalesce('v' || lang, 'n') AS key, CAST(doc_id AS VARCHAR) AS id,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS chars, coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS more, coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents),
hashed AS (
  SELECT doc_id, key, sha256(head || chars || tail) AS leaf, sha256(head || more || tail) AS other,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(id) + 1), lambda i: ord(id[i])::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, j: xor(d >> 1, CASE WHEN d % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END)))) AS crc
  FROM given),
leaves AS (
  SELECT row_number() OVER (ORDER BY key, doc_id NULLS FIRST, leaf) AS row, doc_id, key, leaf, CASE WHEN doc_id IS NOT NULL AND crc % 7 = 0 THEN other ELSE leaf END AS shown,
    row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS size
  FROM hashed),
low AS (
  SELECT row, key, pos, size, leaf AS node, shown AS fold, '' AS path FROM leaves
  UNION ALL
  SELECT row, key, pos // 2, (size + 1) // 2, sha256(coalesce(a, '') || coalesce(b, '')), sha256(CASE WHEN pos % 2 = 0 THEN fold || coalesce(b, '') ELSE coalesce(a, '') || fold END), path || CASE WHEN pos % 2 = 0 THEN coalesce(b, '') ELSE a END
  FROM (SELECT *, max(CASE WHEN pos % 2 = 0 THEN node END) OVER (PARTITION BY key, pos // 2) AS a, max(CASE WHEN pos % 2 = 1 THEN node END) OVER (PARTITION BY key, pos // 2) AS b FROM low WHERE size > 1)),
subroots AS (SELECT key, min(node) AS node, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS size FROM low WHERE size = 1 GROUP BY key),
high AS (
  SELECT l.row, r.pos, r.size, r.node, l.node AS subroot, l.fold, l.path FROM low l JOIN subroots r USING (key) WHERE l.size = 1
  UNION ALL
  SELECT row, pos // 2, (size + 1) // 2, sha256(coalesce(a, '') || coalesce(b, '')), subroot, sha256(CASE WHEN pos % 2 = 0 THEN fold || coalesce(b, '') ELSE coalesce(a, '') || fold END), path || CASE WHEN pos % 2 = 0 THEN coalesce(b, '') ELSE a END
  FROM (SELECT *, max(CASE WHEN pos % 2 = 0 THEN node END) OVER (PARTITION BY pos // 2) AS a, max(CASE WHEN pos % 2 = 1 THEN node END) OVER (PARTITION BY pos // 2) AS b FROM high WHERE size > 1))
SELECT l.doc_id, l.leaf, h.subroot, h.node AS root, sha256(h.path) AS proof_sha256, h.fold AS folded_root, h.fold = h.node AS verified FROM high h JOIN leaves l USING (row) WHERE h.size = 1
"""
