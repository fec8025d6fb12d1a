"""Readers and sinks: CSV, JSON, FASTA, alignments, Parquet caches. Paths go to Spark's readers and writers, so that any store Spark knows will do."""

from __future__ import annotations

import json
import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that the whole cluster sees: spark.checkpoint.dir; a local one only where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: str | StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV file with a header; only the columns asked for are parsed.

    Values that don't fit their type become null, and bytes that are no UTF-8 become the replacement character: no row is lost.
    """
    rows = spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", encoding="UTF-8", quote='"', escape='"')
    return rows.select(*columns) if columns else rows


def read_csv_auto(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file whose header and values give the schema; this reads the file twice."""
    return spark.read.csv(path, header=True, inferSchema=True, quote='"', escape='"')


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, replacing what is there; Spark's commit protocol shows all files or none."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def csv_to_parquet(spark: SparkSession, source: str, target: str) -> None:
    read_csv_auto(spark, source).write.mode("overwrite").option("compression", "zstd").parquet(target)


def read_json(spark: SparkSession, path: str, schema: str | StructType | None = None, lines: bool = False) -> DataFrame:
    """JSON documents: one a file, or one a line."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=not lines)


def _sorted(column: Column, kind: DataType) -> Column:
    """The column with the fields of its structs in order of their names, at every depth."""
    if isinstance(kind, StructType):
        fields = [_sorted(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: _sorted(x, kind.elementType))
    return column


def _not_finite(column: Column, kind: DataType) -> Column | None:
    """Whether a number in the column is NaN or infinite; null where the type has no such numbers."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.isnan(column) | (F.abs(column) == math.inf)
    if isinstance(kind, StructType):
        parts = [x for f in kind.fields if (x := _not_finite(column[f.name], f.dataType)) is not None]
        return F.greatest(*(F.coalesce(p, F.lit(False)) for p in parts), F.lit(False)) if parts else None
    if isinstance(kind, ArrayType):
        inner = _not_finite(F.lit(None).cast(kind.elementType), kind.elementType)
        return None if inner is None else F.exists(column, lambda x: F.coalesce(_not_finite(x, kind.elementType), F.lit(False)))
    if isinstance(kind, MapType):
        return _not_finite(F.map_values(column), ArrayType(kind.valueType))
    return None


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, keys in order of their names; a NaN or an infinity fails the write, as JSON has none."""
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    bad = _not_finite(whole, df.schema)
    rows = df.select(F.to_json(_sorted(whole, df.schema), {"ignoreNullFields": "false"}).alias("value"), (F.lit(False) if bad is None else F.coalesce(bad, F.lit(False))).alias("bad"))
    checked = F.when(F.col("bad"), F.raise_error(F.lit("a value is NaN or infinite"))).otherwise(F.col("value"))
    rows.select(checked.cast("string").alias("value")).write.mode("overwrite").text(path)


#: White space of Java's patterns.
_BLANK = " \t\n\x0b\f\r"


def _records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, at, id, sequence) of FASTA records as they stand; `at` rises within a file."""
    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.option("lineSep", "\n>").text(paths)
    # Records of one block have rising numbers, and blocks rise within a file.
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = raw.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.col("_metadata.file_block_start").alias("block"), "value")
    rows = rows.where((F.col("block") > 0) | F.col("value").startswith(">") | (F.col("at.row").bitwiseAND((1 << 33) - 1) > 0))
    # The first line, and the rest without white space around its line ends. A sequence in one line is not searched for patterns, which takes longer than all else.
    end = F.locate("\n", F.col("value"))
    plain = (end > 0) & ~F.contains(F.col("value"), F.lit("\r")) & (F.substring_index("value", "\n", 2) == F.col("value"))
    line = F.when(plain, F.substring_index("value", "\n", 1)).otherwise(F.col("value"))
    head = F.regexp_extract(line, r"^>?([^\r\n]*)", 1)
    lines = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s*[\r\n]\s*|^\s+|\s+$", "")
    body = F.when(plain, F.btrim(F.substring_index("value", "\n", -1), F.lit(_BLANK))).otherwise(lines)
    return rows.select("file", "at", F.regexp_extract(F.trim(head), r"^(\S+)", 1).alias("id"), body.alias("sequence")).where("id <> ''")


def read_fasta(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, id, sequence): a header's first word, and the lines below it joined. Of records with the same id in a file the last wins.

    Files are split at line ends followed by >, so that a large one is read by many tasks. Text before the first header is dropped.
    """
    return _records(spark, path).groupBy("file", "id").agg(F.max_by("sequence", "at").alias("sequence"))


def write_fasta(df: DataFrame, path: str, id_col: str, sequence_col: str, width: int = 60) -> None:
    """Records in lines of `width` symbols; rows without id or sequence are left out."""
    lines = F.regexp_replace(F.col(sequence_col), f"(.{{{width}}})(?=.)", "$1\n")
    df.where(F.col(id_col).isNotNull() & F.col(sequence_col).isNotNull()).select(F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit("\n"), lines).alias("value")).write.mode("overwrite").text(path)


def read_alignments(spark: SparkSession, folder: str, taxa: Sequence[str], main: str = "human", packed: bool = False) -> DataFrame:
    """(accession, taxon, member, sequence, main_sequence) of the aligned files accession.afa of a folder, one row for each known taxon.

    A header is taxon_member. The main row is named `main` or by the file's accession; files without one are left out, as are
    names with anything but letters, digits and hyphens before .afa (hashed variants). A folder as `write.partitionBy("afa")` makes them (afa=accession.afa) is
    a file, too. packed: files of any name hold many accessions, with headers accession|taxon_member, as tables of many small alignments need.
    """
    if packed:
        parts = F.split("id", r"\|", 2)
        rows = _records(spark, folder).where(F.size(parts) == 2).select(parts[0].alias("accession"), "file", parts[1].alias("id"), "at", "sequence").where("accession <> ''")
        rows = rows.repartition("accession").groupBy("accession", "file", "id").agg(F.max_by("sequence", "at").alias("sequence"))
        own = ((F.col("id") == main) | (F.col("id") == F.col("accession"))) & (F.col("sequence") != "")
        p = F.split("id", "_", 2)
        other = F.when((F.size(p) == 2) & p[0].isin(*taxa), F.struct(p[0].alias("taxon"), p[1].alias("member"), "sequence"))
        packs = rows.groupBy("accession").agg(F.max_by(F.when(own, F.col("sequence")), F.when(own, F.col("id") == main)).alias("main_sequence"), F.collect_list(other).alias("others"))
        return packs.where("main_sequence IS NOT NULL").select("accession", "main_sequence", F.explode("others").alias("o")).select("accession", "o.taxon", "o.member", "o.sequence", "main_sequence")
    rows = read_fasta(spark, f"{folder}/*.afa")
    rows = rows.withColumn("accession", F.regexp_extract("file", r"/(?:afa=)?([A-Za-z0-9-]+)\.afa(?:/[^/]*)?$", 1)).where("accession <> ''")
    own = rows.where(((F.col("id") == main) | (F.col("id") == F.col("accession"))) & (F.col("sequence") != "")).groupBy("accession").agg(F.max_by("sequence", F.col("id") == main).alias("main_sequence"))
    parts = rows.select("accession", F.split("id", "_", 2).alias("p"), "sequence").where(F.size("p") == 2)
    return parts.where(F.col("p")[0].isin(*taxa)).select("accession", F.col("p")[0].alias("taxon"), F.col("p")[1].alias("member"), "sequence").join(own, "accession")


def saved(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: what made it is not run again, whatever executors are lost."""
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete what saved() wrote and nothing reads any more."""
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialised(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A temporary table: df is written once to the shared folder and read under this name, however often it is used."""
    found = saved(spark, df, name)
    found.createOrReplaceTempView(name)
    return found


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """What is stored at path, made and written there where nothing complete is."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of each file; a task holds one file at a time, of 2 GB at most."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def tree_digest(files: DataFrame, root: str) -> DataFrame:
    """(files, digest): SHA-256 of the sorted lines of path, tab, hash. One row for each file is gathered, never contents."""
    inside = F.regexp_replace("file", "^.*" + root.rstrip("/").split("/")[-1] + "/", "")
    lines = files.agg(F.array_join(F.array_sort(F.collect_list(F.concat(inside, F.lit("\t"), F.col("sha256"), F.lit("\n")))), "").alias("text"), F.count("*").alias("files"))
    return lines.select("files", F.sha2("text", 256).alias("digest"))


def receipts_hold(receipts: DataFrame, now: DataFrame) -> DataFrame:
    """(file, reason): ok, missing, unexpected, size or hash of each file of a stored manifest against the present one."""
    a, b = receipts.select("file", F.col("bytes").alias("b1"), F.col("sha256").alias("h1")), now.select("file", F.col("bytes").alias("b2"), F.col("sha256").alias("h2"))
    reason = F.when(F.col("h2").isNull(), "missing").when(F.col("h1").isNull(), "unexpected").when(F.col("b1") != F.col("b2"), "size").when(F.col("h1") != F.col("h2"), "hash").otherwise("ok")
    return a.join(b, "file", "full_outer").select("file", reason.alias("reason"))


def checked_config(given: dict, schema: dict) -> dict:
    """The settings, if they fit: schema gives for each name a type, or (type, lowest, highest). Unknown, missing and unfit names raise one error that lists them all."""
    wrong = [f"unknown: {k}" for k in given if k not in schema] + [f"missing: {k}" for k in schema if k not in given]
    for k, want in schema.items():
        kind, low, high = want if isinstance(want, tuple) else (want, -math.inf, math.inf)
        v = given.get(k)
        if k in given and (not isinstance(v, kind) or isinstance(v, bool) and kind is not bool or isinstance(v, (int, float)) and not low <= v <= high):
            wrong.append(f"{k}: {json.dumps(v)}")
    if wrong:
        raise ValueError("; ".join(wrong))
    return given
