"""Labelled training rows for the trained operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm._store import lowest, remainder


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, kept, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most `limit` labelled training rows, the first in order of a hash of the id.

    kept: a function of the remainder column, true for rows to learn from. Rows with a null id or label are
    left out; an id with several labels takes the largest. The sample has at most `limit` rows, so it is broadcast. Only ids
    among the lowest hashes, about 4 * limit, are sorted.
    """
    known = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .where(kept(remainder("doc_id", modulus)))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"), F.xxhash64("doc_id").alias("h"))
    )
    near = known.where(lowest("h", 4 * limit, F.lit(max(known.count(), 1))))
    chosen = near.orderBy("h", "doc_id").limit(limit).drop("h")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
