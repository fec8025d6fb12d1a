"""The queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import centroids, decontam, jaccard, jpeg, langid, lmscore, merkle, packing, pages, pii, quality, sentences, toxicity
from strandlake.llm._store import table


def vocabulary() -> str:
    """The packing vocabulary's place; where it is not installed, packing fails with an import error."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks of documents: pairs of document and item, with matched windows and slots. No row for null texts, ids or items."""
    return decontam.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans, their digest, and all spans, for each row; a null text has none."""
    docs = table(spark, sf_dir, "documents")
    return pii.find(spark, docs, pii.train(docs))


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose sentences, with the indices of these; what stays is in sentences.dedup()."""
    return sentences.removed(spark, table(spark, sf_dir, "documents")).select("doc_id", F.size("removed").alias("n_removed"), F.array_join("removed", ",").alias("removed"))


def op4_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each row, 0 for a text without words, and the offending sentences."""
    return toxicity.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language for each row; und for a text that is null or has no letter."""
    return langid.identify(spark, table(spark, sf_dir, "documents"))


def op6_lm_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each row; a null text is its end only."""
    return lmscore.score(spark, table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each row, repeated rows included; a text without words is by itself."""
    return jaccard.components(spark, table(spark, sf_dir, "documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op8_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each row's payload and stream; a null text is padding only."""
    return jpeg.store_texts(spark, table(spark, sf_dir, "documents"))


def op9_quality_gbdt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each row; a null text is judged as an empty one."""
    return quality.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each row's tokens; a null text is its end token only."""
    return packing.pack(spark, table(spark, sf_dir, "documents"), vocabulary())


def op11_geometric_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and squared distance of each kept vector; vectors with null or non-finite components, or not 64 of them, have no row."""
    return centroids.assigned(spark, table(spark, sf_dir, "embeddings"))


def op12_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page; a null html has an empty one."""
    return pages.extract(spark, table(spark, sf_dir, "pages"))


def op13_slot_pivot_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of each row, and what a tampered row's proof leads to; any column may be null."""
    return merkle.audit(spark, table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op3_sentence_spans": sentences.SQL, "op7_jaccard_join": jaccard.SQL, "op11_geometric_kmeans": centroids.SQL, "op13_slot_pivot_merkle": merkle.SQL}
