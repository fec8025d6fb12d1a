"""Boosted trees over grouped folds: out-of-fold scores, ablation, nested selection, transfer.

All models of a task (folds, families, candidates) grow together; the driver holds trees, thresholds and metrics only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators import boosting, ranking
from strandlake.operators.boosting import OUT, TRAIN, WATCH, Boosting
from strandlake.operators.draws import base
from strandlake.operators.quantiles import exact
from strandlake.sources import files

#: Buckets by which groups of one size are ranked, so that no task ranks them all.
BUCKETS = 256


def dealt(sizes: Sequence[tuple[int, int]], k: int) -> list[list[int]]:
    """For each (size, how many groups of it), largest size first: how many go to each fold, each group to the lightest fold."""
    load, made = [0] * k, []
    for size, m in sizes:
        take = [0] * k
        if m > 4 * k:  # level the folds, then deal round by round
            top = max(load)
            for f in range(k):
                n = min((top - load[f]) // max(size, 1), m)
                take[f], m = n, m - n
            take = [t + m // k for t in take]
            m %= k
        for _ in range(m):
            f = min(range(k), key=lambda f: (load[f] + take[f] * size, f))
            take[f] += 1
        load = [a + t * size for a, t in zip(load, take, strict=True)]
        made.append(take)
    return made


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """(group, n, fold): whole groups dealt to k folds of about the same number of rows: groups by size descending, each to the lightest fold.

    Null groups are left out. The driver gets the histogram of group sizes, which has at most sqrt(2 * rows) rows. Among groups of one size the order is that of
    a hash, so that the result does not depend on partitions.
    """
    spark = df.sparkSession
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).withColumn("bucket", F.pmod(F.xxhash64(group), F.lit(BUCKETS)))
    counts = sizes.groupBy("n", "bucket").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(W.partitionBy("n").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.join(counts.select("n", "bucket", before.alias("before")), ["n", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("n", "bucket").orderBy(group)))
    histogram = [(r["n"], r["m"]) for r in counts.groupBy("n").agg(F.sum("m").alias("m")).orderBy(F.desc("n")).collect()]
    rows = []
    for (size, _), take in zip(histogram, dealt(histogram, k), strict=True):
        at = 0
        for fold, t in enumerate(take):
            rows.append((size, at + 1, at + t, fold))
            at += t
    plan = spark.createDataFrame(rows, "size long, first long, last long, fold int")
    return ranked.join(F.broadcast(plan), (F.col("n") == F.col("size")) & F.col("rank").between(F.col("first"), F.col("last"))).select(group, "n", "fold")


#: Of every so many training rows one is watched for the early stop.
WATCHED = 10


def _binned(df: DataFrame, id_col: str, label: str, hows: Sequence[Boosting], more: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The written bins of all features that any model has, cut at exact quantiles of all rows (labels take no part), and these features."""
    spark, features = df.sparkSession, list(dict.fromkeys(f for h in hows for f in h.features))
    cuts = boosting.edges(spark, df, features)
    return files.saved(spark, boosting.binned(df, id_col, label, features, cuts, more), "binned"), features


def _role(out: Column, how: Boosting) -> Column:
    """A row's role for a model: not seen, watched or trained on; rows are watched by a hash of their id."""
    watched = F.pmod(base(42, "id"), F.lit(WATCHED)) == 0 if how.patience else F.lit(False)
    return F.when(out, OUT).when(watched, WATCH).otherwise(TRAIN).cast("tinyint")


def _fitted(rows: DataFrame, outs: Sequence[Column], hows: Sequence[Boosting], features: Sequence[str]) -> list[boosting.Model]:
    return boosting.fit(rows.sparkSession, rows.withColumn("roles", F.array(*(_role(o, h) for o, h in zip(outs, hows, strict=True)))), hows, features)


def out_of_fold(df: DataFrame, id_col: str, label: str, group: str, how: Boosting, k: int = 5) -> DataFrame:
    """(id, label, fold, score) of each row with a group, scored by a model that saw no row of its group."""
    rows, features = _binned(df.join(group_folds(df, group, k).drop("n"), group), id_col, label, [how], ["fold"])
    models = _fitted(rows, [F.col("fold") == f for f in range(k)], [how] * k, features)
    made = boosting.scored(rows, models, F.array("fold"))
    return made.select(F.col("id").alias(id_col), F.col("y").alias(label), F.col("model").alias("fold"), "score")


def metrics(scored: DataFrame, label: str) -> DataFrame:
    """(positives, negatives, auroc, ap) of score against label."""
    return ranking.auroc(scored, label, "score").crossJoin(ranking.average_precision(scored, label, "score"))


def ablation(df: DataFrame, id_col: str, label: str, group: str, families: dict[str, Boosting], k: int = 5) -> DataFrame:
    """(family, positives, negatives, auroc, ap): out-of-fold metrics of a model for each family of features; all folds of all families grow together."""
    hows = [h for h in families.values() for _ in range(k)]
    rows, features = _binned(df.join(group_folds(df, group, k).drop("n"), group), id_col, label, hows, ["fold"])
    models = _fitted(rows, [F.col("fold") == f for _ in families for f in range(k)], hows, features)
    scored = files.saved(df.sparkSession, boosting.scored(rows, models, F.array(*(F.col("fold") + i * k for i in range(len(families))))), "scored")
    made = None
    for i, name in enumerate(families):
        part = metrics(scored.where(F.floor(F.col("model") / k) == i), "y").select(F.lit(name).alias("family"), "*")
        made = part if made is None else made.unionByName(part)
    return made


def nested(df: DataFrame, id_col: str, label: str, group: str, candidates: dict[str, Boosting], k: int = 5, inner: int = 3, levels: Sequence[float] = (0.90, 0.95, 0.98, 0.99, 0.995)) -> DataFrame:
    """(outer, chosen, inner_ap, level, threshold, tp, fp, positives, negatives) for each outer fold and level.

    In each outer fold the candidate with the highest average precision over inner folds (ties: the first) is fitted anew on all training rows.
    A threshold is the level's quantile of the inner out-of-fold scores of negatives; tp and fp count held-out rows over it.
    """
    spark, names, hows = df.sparkSession, list(candidates), list(candidates.values())
    folds = files.saved(spark, group_folds(df, group, k).select(group, F.col("fold").alias("outer")), "outer")
    rows = df.join(folds, group)
    for o in range(k):
        part = group_folds(rows.where(F.col("outer") != o), group, inner).select(group, F.col("fold").alias(f"inner{o}"))
        folds = folds.join(part, group, "left")
    rows, features = _binned(df.join(files.saved(spark, folds, "inner"), group), id_col, label, hows, ["outer", *(f"inner{o}" for o in range(k))])
    place = [(o, c, i) for o in range(k) for c in range(len(names)) for i in range(inner)]
    models = _fitted(rows, [F.col(f"inner{o}").isNull() | (F.col(f"inner{o}") == i) for o, _, i in place], [hows[c] for _, c, _ in place], features)
    of_inner = F.array_compact(F.array(*(F.when(F.col(f"inner{o}") == i, F.lit(m)) for m, (o, _, i) in enumerate(place))))
    width = len(names) * inner
    scores = files.saved(spark, boosting.scored(rows, models, of_inner).select("y", F.floor(F.col("model") / width).cast("int").alias("outer"), (F.floor(F.col("model") / inner) % len(names)).cast("int").alias("candidate"), "score").where("y IS NOT NULL"), "inner-scores")
    chosen = []
    for o in range(k):
        aps = [ranking.average_precision(scores.where((F.col("outer") == o) & (F.col("candidate") == c)), "y", "score").first()["ap"] or 0.0 for c in range(len(names))]
        chosen.append((o, aps.index(max(aps)), max(aps)))
    picks = spark.createDataFrame([(o, c, names[c], float(ap)) for o, c, ap in chosen], "outer int, candidate int, chosen string, inner_ap double")
    cuts = exact(spark, scores.where("y = 0").join(F.broadcast(picks), ["outer", "candidate"]), ["outer"], "score", {f"t{i}": level for i, level in enumerate(levels)})
    final = _fitted(rows, [F.col("outer") == o for o in range(k)], [hows[c] for _, c, _ in chosen], features)
    held = boosting.scored(rows, final, F.array("outer")).where("y IS NOT NULL").withColumnRenamed("model", "outer").join(F.broadcast(cuts), "outer", "left")
    counts = held.groupBy("outer").agg(F.sum("y").alias("positives"), F.sum(1 - F.col("y")).alias("negatives"), *(F.max(f"t{i}").alias(f"t{i}") for i in range(len(levels))), *(F.count_if((F.col("score") > F.col(f"t{i}")) & (F.col("y") == y)).alias(f"{x}{i}") for i in range(len(levels)) for x, y in (("tp", 1), ("fp", 0))))
    each = F.explode(F.array(*(F.struct(F.lit(float(level)).alias("level"), F.col(f"t{i}").alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, level in enumerate(levels))))
    made = counts.select("outer", "positives", "negatives", each.alias("e")).join(F.broadcast(picks), "outer")
    return made.select("outer", "chosen", "inner_ap", "e.*", "positives", "negatives")


def transfer(source: DataFrame, target: DataFrame, id_col: str, label: str, group: str, how: Boosting) -> DataFrame:
    """(id, label, score) of the target's rows, by a model of the source's rows whose groups the target does not have."""
    kept = source.join(target.select(group).distinct(), group, "left_anti")
    columns = [id_col, label, *how.features]
    both = kept.select(*columns, F.lit(False).alias("_target")).unionByName(target.select(*columns, F.lit(True).alias("_target")))
    rows, features = _binned(both, id_col, label, [how], ["_target"])
    models = _fitted(rows, [F.col("_target")], [how], features)
    return boosting.scored(rows.where("_target"), models, F.array(F.lit(0))).select(F.col("id").alias(id_col), F.col("y").alias(label), "score")
