"""A pipeline over the documents table; each stage reads what the one before it has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import decontam, jaccard, packing, pii, quality
from strandlake.llm._store import bounded, save, table
from strandlake.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. A null or empty text is judged as one without any statistics; rows that repeat an id are judged each by its text; an empty table stays empty."""
    bounded(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.kept(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id; where rows repeat that, the one with the smallest hash of its text, and of equal rows one.

    Rows without words, or with a null id, are in no group and stay.
    """
    bounded(spark)
    return jaccard.keep_first(spark, docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have an item of the benchmark, also re-parameterised, go, with all rows of their id. Null texts and rows with a null id stay; null items match nothing."""
    bounded(spark)
    return decontam.decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; of overlapping spans the first one's. Null and empty texts stay as they are, and so do repeated rows, each by itself."""
    bounded(spark)
    return pii.redact(docs, pii.train(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens. A null or empty text is its end token; a null id stays null; repeated rows are packed one by one."""
    bounded(spark)
    return packing.pack(spark, docs, vocabulary())


STAGES = [("quality classifier", quality_stage), ("n-gram Jaccard join", near_duplicate_stage), ("benchmark decontamination", decontamination_stage), ("PII", pii_stage), ("packing", packing_stage)]
#: SQL can express neither a trained classifier nor a tokenizer's merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
