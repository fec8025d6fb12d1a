"""Position weight matrices: many matrices as a table, peptides scored by all of them, percentiles within a reference of each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import ranking

#: Weights of all matrices that tasks get, some 8 bytes each.
MOST = 4_000_000


def windows(sites: DataFrame, text: str, position: str, reach: int) -> DataFrame:
    """sites with peptide: the symbols up to `reach` around a position (from 1) of the text, in capitals, `_` beyond its ends; sites outside the text go."""
    t, p = F.upper(F.col(text)), F.col(position).cast("int")
    inside = sites.where((p >= 1) & (p <= F.length(text)))
    start = F.greatest(p - reach, F.lit(1))
    left = F.substr(t, start, p - start)
    return inside.withColumn("peptide", F.concat(F.lpad(left, reach, "_"), F.rpad(F.substr(t, p, F.lit(reach + 1)), reach + 1, "_")))


def _weights(matrices: DataFrame, reach: int) -> tuple[list[str], np.ndarray]:
    """The matrices' names, and their weights as (offset, letter, matrix)."""
    known = matrices.select(F.col("matrix").cast("string").alias("matrix"), F.col("offset").cast("int").alias("offset"), "letter", F.col("weight").cast("double").alias("weight")).dropna()
    n = known.count()
    if n > MOST:
        raise ValueError(f"{n} weights; at most {MOST} fit every task")
    rows = known.toArrow().to_pandas()
    rows = rows[rows["offset"].abs() <= reach]
    names = sorted(rows["matrix"].unique())
    weight = np.zeros((2 * reach + 1, 128, len(names)))
    at = {m: i for i, m in enumerate(names)}
    for m, o, letter, w in rows.itertuples(index=False):
        if len(letter) == 1 and letter.isascii():
            weight[o + reach, ord(letter), at[m]] += w
    weight[:, 0] = 0
    return names, weight


def _scored(peptides: list[str], weight: np.ndarray) -> np.ndarray:
    """(peptides, matrices): the sums of weights of peptides of one length."""
    code = np.frombuffer("".join(peptides).encode("utf-32-le"), np.uint32).reshape(-1, len(weight))
    code = np.where(code < 128, code, 0)
    return sum(weight[o, code[:, o]] for o in range(len(weight)))


def scores(peptides: DataFrame, keys: list[str], matrices: DataFrame, reach: int) -> DataFrame:
    """(keys, matrix, score): each peptide of 2 * reach + 1 symbols by each matrix (matrix, offset, letter, weight): the sum of the weights of its symbols at their offsets.

    Letters and offsets without a weight add 0, as do symbols other than ASCII. Null peptides and those of another length have no rows. The matrices go to every
    task, at most MOST weights; more raise an error.
    """
    names, weight = _weights(matrices, reach)
    kinds = ", ".join(f"`{k}` {dict(peptides.dtypes)[k]}" for k in keys)

    def run(batches):
        for b in batches:
            text = b.column("peptide").to_pylist()
            use = np.array([i for i, t in enumerate(text) if t is not None and len(t) == 2 * reach + 1], dtype=np.int64)
            if not len(use) or not names:
                continue
            made = _scored([text[i] for i in use], weight)
            taken = pa.array(np.repeat(use, len(names)))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(taken) for k in keys), pa.array(names * len(use), pa.string()), pa.array(made.ravel())], names=[*keys, "matrix", "score"])

    return peptides.select(*keys, "peptide").mapInArrow(run, f"{kinds}, matrix string, score double")


def percentiles(scored: DataFrame, reference: DataFrame) -> DataFrame:
    """scored (..., matrix, score) with percentile: the share, in hundredths, of its matrix's reference scores that are at most the score; null for a matrix without any.

    The reference's distinct scores are ranked by ranges. A score that the reference does not have takes the rank of the largest one below it.
    """
    counts = reference.where("score IS NOT NULL").groupBy("matrix", "score").agg(F.count("*").cast("double").alias("n"))
    wanted = scored.select("matrix", "score").where("score IS NOT NULL").distinct().withColumn("n", F.lit(0.0))
    steps = counts.unionByName(wanted).groupBy("matrix", "score").agg(F.sum("n").alias("n"))
    total = counts.groupBy("matrix").agg(F.sum("n").alias("total"))
    ranked = ranking.cumulated(steps, "score", ["n"], ["matrix"]).join(total, "matrix", "left")
    ranked = ranked.select("matrix", "score", F.try_divide(100 * (F.col("n_before") + F.col("n")), F.col("total")).alias("percentile"))
    return scored.join(ranked, ["matrix", "score"], "left")


def pairs(case: DataFrame, control: DataFrame, keys: list[str], high: float = 90.0) -> tuple[DataFrame, DataFrame]:
    """Of percentiles of cases and their controls (keys, matrix, percentile): for each pair how many matrices are over `high` and the largest percentile on both sides,
    and for each matrix the means of both and their difference, over pairs that both have."""
    both = case.select(*keys, "matrix", F.col("percentile").alias("a")).join(control.select(*keys, "matrix", F.col("percentile").alias("b")), [*keys, "matrix"]).dropna()
    by_pair = both.groupBy(*keys).agg(F.count_if(F.col("a") > high).alias("case_high"), F.count_if(F.col("b") > high).alias("control_high"), F.max("a").alias("case_max"), F.max("b").alias("control_max"))
    by_matrix = both.groupBy("matrix").agg(F.count("*").alias("n_pairs"), F.avg("a").alias("case_mean"), F.avg("b").alias("control_mean"))
    return by_pair, by_matrix.withColumn("delta", F.col("case_mean") - F.col("control_mean"))


def cut(texts: DataFrame, sites: DataFrame, reach: int, on: int) -> DataFrame:
    """(entity, pos, focal, case, control): the peptides, as windows() has them, around each site and `on` symbols after it; control is null beyond the text.

    texts: (entity, s), sites: (entity, pos, focal), a row for each position. An entity's sites are one array, so that its text is shuffled and read once, not for every site.
    """
    places = sites.select("entity", F.struct(F.col("pos").cast("long").alias("pos"), F.col("focal").cast("boolean").alias("focal")).alias("at")).where("at.pos IS NOT NULL").groupBy("entity").agg(F.collect_list("at").alias("at"))
    given = texts.select("entity", F.upper("s").alias("s")).where("s IS NOT NULL").join(places, "entity").select("entity", "s", F.col("at.pos").alias("pos"), F.col("at.focal").alias("focal"))
    width = 2 * reach + 1

    def run(batches):
        for b in batches:
            pos, focal, cases, controls, counts = [], [], [], [], []
            for text, at, own in zip(b.column("s").to_pylist(), b.column("pos").to_pylist(), b.column("focal").to_pylist(), strict=True):
                edge = np.full(reach, ord("_"), np.uint32)
                code = np.concatenate([edge, np.frombuffer(text.encode("utf-32-le"), np.uint32), edge])
                p = np.array(at, np.int64)
                keep = (p >= 1) & (p <= len(text))
                p = p[keep]
                pos.append(p)
                focal += [f for f, k in zip(own, keep.tolist(), strict=True) if k]
                counts.append(len(p))
                for q, out in ((p, cases), (p + on, controls)):
                    inside = (q >= 1) & (q <= len(text))
                    letters = code[(q[inside] - 1)[:, None] + np.arange(width)].tobytes().decode("utf-32-le")
                    rank = np.cumsum(inside) - 1
                    out += [letters[r * width : (r + 1) * width] if i else None for r, i in zip(rank.tolist(), inside.tolist(), strict=True)]
            taken = pa.array(np.repeat(np.arange(len(b)), counts).astype(np.int64))
            columns = [b.column("entity").take(taken), pa.array(np.concatenate([np.zeros(0, np.int64), *pos])), pa.array(focal, pa.bool_()), pa.array(cases, pa.string()), pa.array(controls, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["entity", "pos", "focal", "case", "control"])

    kind = given.schema["entity"].dataType.simpleString()
    return given.mapInArrow(run, f"entity {kind}, pos long, focal boolean, case string, control string")


def ranked(found: DataFrame, matrices: DataFrame, reach: int) -> DataFrame:
    """(matrix, score, cases, controls, percentile) of each matrix's scores of the peptides of cut(): how many focal sites with a control have the score, how many of their controls, and its
    percentile among all sites, as percentiles() has it. Tasks count scores, so that no row is made for a site and a matrix."""
    names, weight = _weights(matrices, reach)
    schema = pa.schema([("matrix", pa.string()), ("score", pa.float64()), ("n", pa.float64()), ("cases", pa.int64()), ("controls", pa.int64())])

    def run(batches):
        for b in batches:
            if not len(b) or not names:
                continue
            control = b.column("control").to_pylist()
            pair = np.array([bool(f) and c is not None for f, c in zip(b.column("focal").to_pylist(), control, strict=True)])
            case, other = _scored(b.column("case").to_pylist(), weight), _scored([c for c, p in zip(control, pair.tolist(), strict=True) if p], weight)
            for m, name in enumerate(names):
                values, at = np.unique(np.concatenate([case[:, m], other[:, m]]), return_inverse=True)
                count = lambda x, k=len(values): np.bincount(x, minlength=k)
                n, cases, controls = count(at[: len(case)]), count(at[: len(case)][pair]), count(at[len(case) :])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(values)), pa.array(values), pa.array(n.astype(float)), pa.array(cases), pa.array(controls)], schema=schema)

    steps = found.select("focal", "case", "control").mapInArrow(run, "matrix string, score double, n double, cases long, controls long").groupBy("matrix", "score").agg(*(F.sum(c).alias(c) for c in ("n", "cases", "controls")))
    made = ranking.cumulated(steps, "score", ["n"], ["matrix"])
    total = made.groupBy("matrix").agg(F.sum("n").alias("total"))
    return made.join(total, "matrix").select("matrix", "score", "cases", "controls", F.try_divide(100 * (F.col("n_before") + F.col("n")), F.col("total")).alias("percentile"))


def by_matrix(steps: DataFrame) -> DataFrame:
    """Of ranked(), what pairs() has of each matrix."""
    mean = lambda c: F.sum(F.col(c) * F.col("percentile")) / F.sum(c)
    made = steps.groupBy("matrix").agg(F.sum("cases").alias("n_pairs"), mean("cases").alias("case_mean"), mean("controls").alias("control_mean")).where("n_pairs > 0")
    return made.withColumn("delta", F.col("case_mean") - F.col("control_mean"))


def by_pair(found: DataFrame, steps: DataFrame, matrices: DataFrame, reach: int, high: float = 90.0, most: int = MOST) -> DataFrame:
    """Of cut() and ranked(), what pairs() has of each focal site with a control. Tasks get the percentiles of all scores, at most `most`; more are joined."""
    focal, keys = found.where("focal AND control IS NOT NULL"), ["entity", "pos"]
    known = steps.select("matrix", "score", "percentile").limit(most + 1).toArrow().to_pandas()
    if len(known) > most:
        sides = (scores(focal.withColumn("peptide", F.col(c)), keys, matrices, reach).join(steps, ["matrix", "score"]) for c in ("case", "control"))
        return pairs(*sides, keys, high)[0]
    names, weight = _weights(matrices, reach)
    of = {m: (g["score"].to_numpy(), g["percentile"].to_numpy()) for m, g in known.sort_values("score").groupby("matrix")}

    def run(batches):
        for b in batches:
            if not len(b) or not names:
                continue
            over, top = [], []
            for c in ("case", "control"):
                made = _scored(b.column(c).to_pylist(), weight)
                made = np.stack([of[m][1][np.searchsorted(of[m][0], made[:, i])] for i, m in enumerate(names)], 1)
                over.append(pa.array((made > high).sum(1)))
                top.append(pa.array(made.max(1)))
            yield pa.RecordBatch.from_arrays([b.column("entity"), b.column("pos"), *over, *top], names=[*keys, "case_high", "control_high", "case_max", "control_max"])

    kind = found.schema["entity"].dataType.simpleString()
    return focal.select(*keys, "case", "control").mapInArrow(run, f"entity {kind}, pos long, case_high long, control_high long, case_max double, control_max double")
