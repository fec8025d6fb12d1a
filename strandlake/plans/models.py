"""Queries of the modelling operators over documents: features are shares of letters, labels are `quality`, groups are bundles of documents."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import modelling, structures
from strandlake.operators.boosting import Boosting
from strandlake.plans.base import table
from strandlake.plans.sequences import _COMPOSITION
from strandlake.sources import files

_GEOMETRY = ("log_length", "words", "lines")
_FULL = Boosting((*_COMPOSITION, *_GEOMETRY), trees=16, depth=3, rate=0.25, patience=5)
#: As in the reference: all trees, of small steps, over all training rows.
_WHOLE = Boosting((*_COMPOSITION, *_GEOMETRY), trees=300, depth=3, rate=0.04)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, shares of letters, length, words, lines): each text is counted once, by a table of its bytes. Only ASCII letters are put into capitals; null texts have nulls."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    both = {k: list((x + x.lower()).encode()) for k, x in _COMPOSITION.items()}
    columns = [*both, "length", "words", "lines"]

    def run(batches):
        for b in batches:
            made: dict = {c: [] for c in columns}
            for text in b.column("text").to_pylist():
                n = None if text is None else np.bincount(np.frombuffer(text.encode("utf-8"), np.uint8), minlength=256)
                values = [None] * len(columns) if n is None else [*(int(n[x].sum()) / max(len(text), 1) for x in both.values()), len(text), float(n[32]), float(n[10])]
                for c, v in zip(columns, values, strict=True):
                    made[c].append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), *(pa.array(x, pa.int32() if c == "length" else pa.float64()) for c, x in made.items())], names=["doc_id", "lang", *columns])

    return docs.select("doc_id", "lang", "text").mapInArrow(run, f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, " + ", ".join(f"{c} {'int' if c == 'length' else 'double'}" for c in columns))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, bundle, quality, features) of documents with a label, written once; eight documents with neighbouring ids are a bundle, which stands for a gene."""
    docs = measured(table(spark, sf_dir, "documents")).select("doc_id", "lang", F.floor(F.col("doc_id") / 8).alias("bundle"), *_COMPOSITION, F.log10(F.col("length") + 1).alias("log_length"), "words", "lines")
    return files.saved(spark, docs.join(table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", "quality"), "doc_id"), "labelled")


def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds by size of customers' orders: how many groups and rows each has."""
    made = modelling.group_folds(table(spark, sf_dir, "orders"), "o_custkey", 5)
    return made.groupBy("fold").agg(F.count("*").alias("groups"), F.sum("n").alias("rows"))


def gbt_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = modelling.out_of_fold(labelled(spark, sf_dir), "doc_id", "quality", "bundle", _WHOLE)
    return made.select("doc_id", "fold", "quality", F.round("score", 6).alias("score"))


def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds for each family of features."""
    families = {"composition": tuple(_COMPOSITION), "geometry": _GEOMETRY, "length_only": ("log_length",)}
    made = modelling.ablation(labelled(spark, sf_dir), "doc_id", "quality", "bundle", {k: replace(_FULL, features=f) for k, f in families.items()})
    return made.select("family", "positives", "negatives", F.round("auroc", 9).alias("auroc"), F.round("ap", 9).alias("ap"))


def nested_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five outer and three inner folds, three candidates."""
    small = replace(_FULL, trees=8, patience=3)
    candidates = {"letters": replace(small, features=tuple(_COMPOSITION)), "all": small, "all_balanced": replace(small, balanced=True)}
    made = modelling.nested(labelled(spark, sf_dir), "doc_id", "quality", "bundle", candidates)
    return made.withColumns({c: F.round(c, 9) for c in ("inner_ap", "threshold")})


def transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of English documents scores the others; no bundle of documents is on both sides."""
    rows = labelled(spark, sf_dir)
    scored = modelling.transfer(rows.where("lang = 'en'"), rows.where("lang <> 'en'"), "doc_id", "quality", "bundle", _FULL)
    return scored.select("doc_id", "quality", F.round("score", 6).alias("score"))


def _atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three components of vectors as atoms: labels are chains, a vector is a residue of one carbon."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.lit("embeddings").alias("file"), F.col("label").cast("string").alias("chain"), F.col("vec_id").alias("residue"), F.lit("A").alias("code"), F.lit("C").alias("element"), *((F.col("embedding")[i].cast("double") * 60).alias(c) for i, c in enumerate("xyz")))


def sasa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.surface(_atoms(spark, sf_dir)).select("chain", "residue", F.round("area", 6).alias("area"), "is_surface")


def structure_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residues of one chain near another's atoms."""
    atoms = _atoms(spark, sf_dir)
    return structures.contacts(atoms.where("chain = '0'"), atoms.where("chain = '1'"), 2.0).select("residue")


def nw_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name beside that of the next part."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    pairs = part.join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey")
    made = structures.align(pairs, "p_partkey", "p_name", "other", lambda x, y: 5.0 if x == y else -4.0)
    return made.select("p_partkey", F.size("places").alias("n_pairs"), F.transform("places", lambda p: F.concat_ws(":", p["a"], p["b"])).cast("string").alias("places"))


QUERIES = {group_folds: None, gbt_oof: None, ablation: None, nested_cv: None, transfer: None, sasa: None, nw_align: None, structure_contacts: "WITH p AS (SELECT vec_id, label, embedding[1]::DOUBLE * 60 AS x, embedding[2]::DOUBLE * 60 AS y, embedding[3]::DOUBLE * 60 AS z FROM embeddings) SELECT DISTINCT a.vec_id AS residue FROM p a JOIN p b ON a.label = 0 AND b.label = 1 WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 4"}
