"""Queries over readers and sinks: a table is written in a format and read again, so that its rows have to come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.plans.base import table
from strandlake.sources import files, guards
from strandlake.sources.guards import Guard


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns of a CSV file; names have quotes, commas and line ends."""
    path = files.new_path(spark, "csv")
    rows = table(spark, sf_dir, "customer").withColumn("note", F.concat(F.lit('a "quoted", '), F.col("c_name")))
    files.write_csv(rows.select("c_custkey", "c_name", "c_acctbal", "note", "c_mktsegment"), path)
    return files.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double, note string, c_mktsegment string", ["c_custkey", "c_acctbal", "note"])


def csv_auto_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.new_path(spark, "csv")
    files.write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path)
    rows = files.read_csv_auto(spark, path)
    return rows.groupBy("p_size").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 4).alias("total"), F.max("p_name").alias("last_name"))


def copy_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = files.new_path(spark, "csv"), files.new_path(spark, "copy")
    files.write_csv(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), source)
    files.csv_to_parquet(spark, source, target)
    return spark.read.parquet(target).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name")


def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.new_path(spark, "json")
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    files.write_json(rows.groupBy("r_name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("n_name")).alias("nations")), path)
    return files.read_json(spark, path, "n long, nations array<string>, r_name string", lines=True).select("r_name", "n", F.array_join("nations", "|").alias("nations"))


def fasta_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as sequences in lines of 60; of two records with one id the later stays."""
    path = files.new_path(spark, "fasta")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.regexp_replace("text", r"[^A-Za-z]", "").alias("s"))
    files.write_fasta(docs.withColumn("id", F.concat("id", F.lit(" with more words"))), path, "id", "s")
    return files.read_fasta(spark, path).select("id", F.length("sequence").cast("long").alias("length"), F.md5("sequence").alias("md5"))


def alignment_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a main row and rows of taxa, known ones only; a nation is a file, its suppliers are rows."""
    path = files.new_path(spark, "aligned")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.concat(F.when(F.col("s_suppkey") % 2 == 0, "mouse").otherwise("yeast"), F.lit("_S"), F.col("s_suppkey")).alias("id"), F.translate("s_name", "#0", "--").alias("s"))
    main = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.lit("human").alias("id"), F.col("n_name").alias("s"))
    records = rows.union(main).select(F.concat(F.lit("N"), "k", F.lit(".afa")).alias("afa"), F.concat(F.lit(">"), "id", F.lit("\n"), "s").alias("value"))
    records.repartition("afa").write.partitionBy("afa").text(path)
    return files.read_alignments(spark, path, ["mouse"]).select("accession", "member", "sequence", "main_sequence")


def temp_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that two parts of a query use, made once."""
    files.materialised(spark, table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), "spending")
    return spark.sql("SELECT s.o_custkey, s.n, round(s.total / a.mean, 6) AS share FROM spending s CROSS JOIN (SELECT avg(total) AS mean FROM spending) a WHERE s.total > a.mean")


def parquet_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache holds; the second call reads it, and would fail if it made it anew."""
    path = files.new_path(spark, "cache")
    files.cached(spark, path, lambda: table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n")))
    return files.cached(spark, path, lambda: None)


def input_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, bytes and hash of the files of three small tables."""
    made = files.manifest(spark, f"{sf_dir}/{{region,nation,supplier}}.parquet")
    return made.select(F.element_at(F.split("file", "/"), -1).alias("name"), "bytes", "sha256")


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored manifest held against the files as they are: one entry's hash is altered, one is of a file that is not there."""
    now = input_manifest(spark, sf_dir).withColumnRenamed("name", "file")
    stored = files.materialised(spark, now.where("file <> 'supplier.parquet'").withColumn("sha256", F.when(F.col("file") == "nation.parquet", F.lit("0")).otherwise(F.col("sha256"))).union(spark.createDataFrame([("gone.parquet", 1, "0")], "file string, bytes long, sha256 string")), "receipts")
    return files.receipts_hold(stored, now)


def shard_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in six shards, of which some lose a key, repeat rows, have blanks or lack a column: why each is refused, and how many rows are kept."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice").withColumn("shard", (F.col("o_orderkey") % 6).cast("int"))
    guard = Guard({"o_orderkey": "bigint", "o_orderpriority": "string", "o_totalprice": ""}, ["o_orderkey"], ["o_orderpriority"], 1)
    odd = F.col("o_custkey") % 10 == 0
    spoilt = {
        1: lambda d: d.withColumn("o_orderkey", F.when(~odd, F.col("o_orderkey"))),
        2: lambda d: d.union(d.where(odd)),
        3: lambda d: d.withColumn("o_orderpriority", F.when(odd, "  ").otherwise(F.col("o_orderpriority"))),
        4: lambda d: d.drop("o_totalprice").withColumn("o_orderkey", F.col("o_orderkey").cast("string")),
        5: lambda d: d.where("false"),
    }
    made = []
    for k in range(6):
        shard = orders.where(F.col("shard") == k)
        path = files.new_path(spark, f"shard{k}")
        reasons = guards.write(spark, spoilt[k](shard) if k in spoilt else shard, path, guard)
        made.append((k, "; ".join(reasons) or "ok", 0 if reasons else spark.read.parquet(path).count()))
    return spark.createDataFrame(made, "shard int, reason string, kept long")


QUERIES = {
    csv_scan: """SELECT c_custkey, c_acctbal, 'a "quoted", ' || c_name AS note FROM customer""",
    csv_auto_scan: "SELECT p_size, count(*) AS n, round(sum(p_retailprice), 4) AS total, max(p_name) AS last_name FROM part GROUP BY p_size",
    copy_parquet: "SELECT s_suppkey, s_name FROM supplier",
    json_scan: "SELECT r_name, count(*) AS n, string_agg(n_name, '|' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    fasta_parse: "SELECT 'd' || doc_id AS id, length(s) AS length, md5(s) AS md5 FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS s FROM documents WHERE text IS NOT NULL) t",
    alignment_load: "SELECT 'N' || s_nationkey AS accession, 'S' || s_suppkey AS member, translate(s_name, '#0', '--') AS sequence, n_name AS main_sequence FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 0",
    temp_table: "WITH spending AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT o_custkey, n, round(total / (SELECT avg(total) FROM spending), 6) AS share FROM spending WHERE total > (SELECT avg(total) FROM spending)",
    parquet_cache: "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic",
    input_manifest: None,
    shard_guards: "WITH o AS (SELECT o_orderkey % 6 AS k, count(*) AS n, count(*) FILTER (WHERE o_custkey % 10 = 0) AS odd FROM orders GROUP BY 1) SELECT s.k::INTEGER AS shard, CASE WHEN s.k = 4 THEN 'no column o_totalprice; column o_orderkey is string, not bigint' WHEN s.k = 5 OR coalesce(n, 0) = 0 THEN '0 rows, not 1' WHEN s.k = 0 OR odd = 0 THEN 'ok' WHEN s.k = 1 THEN odd || ' blank o_orderkey' WHEN s.k = 2 THEN odd || ' repeated o_orderkey' ELSE odd || ' blank o_orderpriority' END AS reason, CASE WHEN s.k = 0 OR s.k < 4 AND odd = 0 THEN n ELSE 0 END::BIGINT AS kept FROM (SELECT unnest(range(6)) AS k) s LEFT JOIN o USING (k)",
    receipts: "SELECT * FROM (VALUES ('region.parquet', 'ok'), ('nation.parquet', 'hash'), ('supplier.parquet', 'unexpected'), ('gone.parquet', 'missing')) t(file, reason)",
}
