"""Redraws as vectors: each partition sums all draws of its rows, so that no row is repeated for a draw.

A draw's number for a row is one of a SplitMix64 stream that the row's key begins: it depends on key, draw and seed only, not on partitions,
and SQL can compute it, too (numbers_sql).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# SplitMix64's step and multipliers.
_STEP, _FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Numbers that a step of the vectorised code holds.
CELLS = 1 << 18


def base(seed: int, *columns: str | Column) -> Column:
    """Where the stream of a key begins: 60 bits of the MD5 of the seed and the columns as text."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def stream(start: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """64-bit numbers of each start (row) and draw (column)."""
    x = start.astype(np.uint64)[:, None] + draws.astype(np.uint64)[None, :] * np.uint64(_STEP)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_FIRST)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_SECOND)
    return x ^ (x >> np.uint64(31))


def numbers_sql(rows: str, start: str, draw: str) -> str:
    """DuckDB's SQL for rows with the same number as `number`, and as `u` between 0 and 1; start and draw name its columns."""
    low = "18446744073709551615::UHUGEINT"
    times = lambda x, by: f"((({x})::UHUGEINT * {by}::UHUGEINT) & {low})::UBIGINT"
    return (
        f"(SELECT * EXCLUDE (x0, x1, x2), xor(x2, x2 >> 31) AS number, (xor(x2, x2 >> 31) >> 11)::DOUBLE * {2.0**-53!r} AS u FROM (SELECT *, {times('xor(x1, x1 >> 27)', _SECOND)} AS x2 FROM "
        f"(SELECT *, {times('xor(x0, x0 >> 30)', _FIRST)} AS x1 FROM (SELECT *, (({start}::UHUGEINT + {draw}::UHUGEINT * {_STEP}::UHUGEINT) & {low})::UBIGINT AS x0 FROM {rows}))))"
    )


def base_sql(seed: int, text: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {text}), 1, 15))::BIGINT"


def uniform(start: np.ndarray, draws: np.ndarray) -> np.ndarray:
    return (stream(start, draws) >> np.uint64(11)).astype(float) * 2.0**-53


def _cuts() -> np.ndarray:
    """Cumulative probabilities of Poisson(1) up to 9."""
    p = np.exp(-1.0) / np.cumprod([1.0, *range(1, 10)])
    return np.cumsum(p)


def poisson(start: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """How often each key is drawn: Poisson(1), which redraws keys with replacement without knowing how many there are."""
    return np.searchsorted(_cuts(), uniform(start, draws), "right").astype(float)


def poisson_sql(u: str) -> str:
    return "(" + " + ".join(f"({u} >= {c!r})::INTEGER" for c in _cuts().tolist()) + ")"


def signs(start: np.ndarray, draws: np.ndarray) -> np.ndarray:
    return np.where(uniform(start, draws) < 0.5, -1.0, 1.0)


def sums(df: DataFrame, key: str, values: Sequence[str], draws: int, seed: int = 42, weights: Callable = poisson, by: str | None = None) -> DataFrame:
    """(by, draw, values): for each draw 1 .. draws, the sum of each value times the weight of its row's key. Rows without a key or with a null value go.

    Rows of one key have one weight. Each partition has one vector of draws a group, and these are added up by draw.
    """
    names = list(values)
    group = F.lit("") if by is None else F.col(by).cast("string")
    rows = df.select(group.alias("by"), base(seed, key).alias("base"), *(F.col(v).cast("double").alias(v) for v in names), F.col(key).alias("key")).dropna(subset=[*names, "key"]).drop("key")
    schema = pa.schema([("by", pa.string()), ("draw", pa.int32()), *((v, pa.float64()) for v in names)])
    numbers = np.arange(1, draws + 1)

    def run(batches):
        total: dict[str | None, np.ndarray] = {}
        for b in batches:
            groups = np.array(b.column("by").to_pylist(), dtype=object)
            starts = b.column("base").to_numpy(zero_copy_only=False)
            v = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names])
            codes, found = pd.factorize(groups, use_na_sentinel=False)
            for g, name in enumerate(found):
                at = np.flatnonzero(codes == g)
                mine = total.setdefault(name, np.zeros((len(names), draws)))
                for some in np.array_split(at, -(-len(at) * draws // CELLS)):
                    mine += v[:, some] @ weights(starts[some], numbers)
        for name, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * draws, pa.string()), pa.array(numbers, pa.int32()), *(pa.array(x) for x in t)], schema=schema)

    parts = rows.mapInArrow(run, "by string, draw int, " + ", ".join(f"`{v}` double" for v in names))
    return parts.groupBy("by", "draw").agg(*(F.sum(v).alias(v) for v in names))


def interval(df: DataFrame, key: str, values: Sequence[str], estimate: Callable[..., Column], draws: int = 1000, seed: int = 42, by: str | None = None) -> DataFrame:
    """(by, n, estimate, ci_low, ci_high): an estimate from sums of values, and its 95 % interval when whole keys are redrawn.

    estimate takes a column for each value's sum; make it null (try_divide) where it is undefined, and draws without an estimate are left out. n counts keys.
    Without rows there is one row of n = 0 and nulls, or with `by` none; with one key all bounds are its estimate.
    """
    kept = df.where(F.col(key).isNotNull()).dropna(subset=list(values)).select(*([F.col(by).cast("string").alias("by")] if by else [F.lit("").alias("by")]), F.col(key).alias("key"), *values)
    whole = kept.groupBy("by").agg(F.count_distinct("key").alias("n"), *(F.sum(F.col(v).cast("double")).alias(v) for v in values)) if by else kept.agg(F.lit("").alias("by"), F.count_distinct("key").alias("n"), *(F.sum(F.col(v).cast("double")).alias(v) for v in values))
    whole = whole.select("by", "n", estimate(*(F.col(v) for v in values)).alias("estimate"))
    drawn = sums(kept, "key", values, draws, seed, by="by").select("by", estimate(*(F.col(v) for v in values)).alias("e"))
    bounds = drawn.groupBy("by").agg(F.percentile("e", 0.025).alias("ci_low"), F.percentile("e", 0.975).alias("ci_high"))
    made = whole.join(bounds, "by", "left")
    return made.withColumnRenamed("by", by) if by else made.drop("by")


def mean(df: DataFrame, key: str, value: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """The mean over rows; a key with more rows weighs more."""
    return interval(df.withColumn("one", F.when(F.col(value).isNotNull(), 1.0)), key, [value, "one"], F.try_divide, draws, seed)


def ratio(df: DataFrame, key: str, above: str, below: str, draws: int = 1000, seed: int = 42, by: str | None = None) -> DataFrame:
    """The ratio of two sums, or of two means over the same rows."""
    return interval(df, key, [above, below], F.try_divide, draws, seed, by)


def double_ratio(df: DataFrame, key: str, first: tuple[str, str], second: tuple[str, str], draws: int = 1000, seed: int = 42, by: str | None = None) -> DataFrame:
    """(a / b) / (c / d) of sums over keys that have all four: both ratios are redrawn with the same keys."""
    return interval(df, key, [*first, *second], lambda a, b, c, d: F.try_divide(F.try_divide(a, b), F.try_divide(c, d)), draws, seed, by)


def sign_flip(df: DataFrame, key: str, value: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(n, mean, p): two-sided p = (draws whose mean is at least as far from 0 + 1) / (draws + 1), each key's sign flipped by itself. Nulls go; no rows: p is 1."""
    rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    seen = rows.agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double")).alias("total"))
    # Sums in another order may differ in their last bits.
    far = sums(rows, key, [value], draws, seed, signs).select(F.abs(value).alias("far")).join(F.broadcast(seen), F.col("far") >= F.abs("total") - 1e-9).agg(F.count("*").alias("extreme"))
    p = F.when(F.col("n") == 0, 1.0).otherwise((F.col("extreme") + 1) / (draws + 1.0))
    return seen.crossJoin(F.broadcast(far)).select("n", F.try_divide("total", "n").alias("mean"), p.alias("p"))


def auroc(df: DataFrame, key: str, label: str, score: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(n, estimate, ci_low, ci_high) of the area under the ROC curve (ties count half), whole keys redrawn; label is 0 or 1.

    Rows are dealt by ranges of scores. A range sums, for each draw, its weights of both kinds and the pairs within it; pairs
    across ranges come from sums of the ranges below. Draws without one of the kinds are left out; without rows of both kinds the estimate is null.
    """
    rows = df.select(base(seed, key).alias("base"), F.col(key).alias("key"), F.col(label).cast("int").alias("label"), F.col(score).cast("double").alias("score")).dropna()
    counted = rows.groupBy("base", "key", "label", "score").agg(F.count("*").cast("double").alias("n"))
    dealt = counted.repartitionByRange("score").sortWithinPartitions("score").select(F.spark_partition_id().alias("part"), "base", "label", "score", "n")
    schema = pa.schema([("part", pa.int32()), ("draw", pa.int32()), ("pos", pa.float64()), ("neg", pa.float64()), ("inside", pa.float64())])
    numbers = np.arange(draws + 1)

    def weight(start: np.ndarray) -> np.ndarray:
        w = poisson(start, numbers)
        w[:, 0] = 1  # draw 0 is the rows as they are
        return w

    def run(batches):
        part, last = 0, None
        pos, neg, inside, tied_pos, tied_neg = np.zeros((5, draws + 1))
        for b in batches:
            part = b.column("part")[0].as_py() if len(b) else part
            start, y, s, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("base", "label", "score", "n"))
            step = max(1, CELLS // (draws + 1))
            for i in range(0, len(s), step):
                w = weight(start[i : i + step]) * n[i : i + step, None]
                cut = s[i : i + step]
                ends = np.append(np.flatnonzero(cut[1:] != cut[:-1]) + 1, len(cut))
                begin = 0
                for e in ends.tolist():
                    if cut[begin] != last:
                        # A finished score's pairs: with all below, and half of those at the same score.
                        inside += tied_pos * (neg + 0.5 * tied_neg)
                        pos, neg, last = pos + tied_pos, neg + tied_neg, cut[begin]
                        tied_pos, tied_neg = np.zeros((2, draws + 1))
                    mine, here = w[begin:e], y[i + begin : i + e] > 0
                    tied_pos = tied_pos + mine[here].sum(0)
                    tied_neg = tied_neg + mine[~here].sum(0)
                    begin = e
        inside += tied_pos * (neg + 0.5 * tied_neg)
        pos, neg = pos + tied_pos, neg + tied_neg
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part] * (draws + 1), pa.int32()), pa.array(numbers, pa.int32()), pa.array(pos), pa.array(neg), pa.array(inside)], schema=schema)

    parts = dealt.mapInArrow(run, "part int, draw int, pos double, neg double, inside double")
    below = F.coalesce(F.sum("neg").over(W.partitionBy("draw").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    drawn = parts.withColumn("pairs", F.col("inside") + F.col("pos") * below).groupBy("draw").agg(F.try_divide(F.sum("pairs"), F.sum("pos") * F.sum("neg")).alias("e"))
    made = drawn.agg(F.max(F.when(F.col("draw") == 0, F.col("e"))).alias("estimate"), F.percentile(F.when(F.col("draw") > 0, F.col("e")), 0.025).alias("ci_low"), F.percentile(F.when(F.col("draw") > 0, F.col("e")), 0.975).alias("ci_high"))
    return rows.agg(F.count_distinct("key").alias("n")).crossJoin(F.broadcast(made))


def chosen(start: np.ndarray, stratum: np.ndarray, marked: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """(places, draws): in each draw, as many places of each stratum as are marked, those with the smallest numbers of their streams."""
    out = np.zeros((len(start), len(draws)), bool)
    for s in np.unique(stratum):
        at = np.flatnonzero(stratum == s)
        k = int(marked[at].sum())
        if k == len(at):
            out[at] = True
        elif k:
            numbers = stream(start[at], draws)
            if k == 1:
                out[at[numbers.argmin(0)], np.arange(len(draws))] = True
            elif k == len(at) - 1:
                out[at] = True
                out[at[numbers.argmax(0)], np.arange(len(draws))] = False
            else:
                smallest = np.argpartition(np.ascontiguousarray(numbers.T), k - 1, axis=1)[:, :k]
                out[at[smallest], np.arange(len(draws))[:, None]] = True
    return out


def close(positions: np.ndarray, there: np.ndarray, radii: Sequence[int]) -> np.ndarray:
    """(radii, draws): pairs of places, both there, at most each radius apart; positions ascend."""
    # Pairs are fewer than half the square of the places, so that small sums do for most.
    kind = np.int32 if len(there) < 40_000 else np.int64
    seen = np.concatenate([np.zeros((1, there.shape[1]), kind), np.cumsum(there, 0, dtype=kind)])
    mine = there.astype(kind)
    # A place's own number and those before it: 1 + 2 + ... over all that are there.
    before = seen[-1].astype(np.int64) * (seen[-1].astype(np.int64) + 1) // 2
    return np.stack([np.einsum("ij,ij->j", mine, seen[np.searchsorted(positions, positions + r, "right")], dtype=np.int64, casting="safe") - before for r in radii])


def dealt(rows: DataFrame, draws: int, per_task: int) -> DataFrame:
    """Entities' places with blocks of their draws, `width` draws from the one after `first`: few places have more draws a block, up to CELLS numbers."""
    # A given number of tasks: the rows are small and their work is not, so that tasks must not be joined by size.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.least(F.greatest(F.lit(per_task), F.floor(F.lit(CELLS) / F.size("p"))), F.lit(draws)).cast("int")
    return rows.select("entity", *(F.col("p").getField(c).alias(c) for c in ("pos", "base", "stratum", "marked")), F.explode(F.sequence(F.lit(0), F.lit(draws - 1), size)).alias("first"), size.alias("width")).repartition(tasks, "entity", "first")


def stratified_null(pool: DataFrame, entity: str, pos: str, stratum: str, marked: str, radii: Sequence[int] = (5, 10, 15, 20, 25, 30), draws: int = 2000, seed: int = 42, per_task: int = 100) -> DataFrame:
    """Close pairs of each entity's marked places against draws of as many places from each stratum, without replacement.

    (entity, radius, n_sites, n_strata, n_variable, observed_pairs, possible_pairs, observed, null_mean, null_sd, effect, fold, p): of entities with two marked places or more.
    pool has a row for each place (distinct positions; repeats go), marked is true or false. A stratum whose places are all marked never varies; n_variable counts
    the marked places of the others. effect: differences below 1e-12 are 0; fold is null where the null is 0; p = (draws with as many pairs + 1) / (draws + 1).
    An entity's places are one row, which its coordinates bound, and its draws are dealt to tasks of `per_task`, or of as many more as make CELLS numbers; rows with nulls go.
    """
    places = pool.select(F.col(entity).alias("entity"), F.col(pos).cast("long").alias("pos"), F.xxhash64(F.col(stratum)).alias("stratum"), F.col(marked).cast("boolean").alias("marked")).dropna().groupBy("entity", "pos").agg(F.min("stratum").alias("stratum"), F.max("marked").alias("marked"))
    places = places.withColumn("base", base(seed, "entity", "pos"))
    rows = places.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("pos", "base", "stratum", "marked"))).alias("p")).where(F.size(F.filter("p", lambda x: x["marked"])) >= 2)
    blocks = dealt(rows, draws, per_task)
    kind = rows.schema["entity"].dataType.simpleString()
    fields = "radius int, n_sites long, n_strata long, n_variable long, observed_pairs long, block int, total double, squares double, as_many long"
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        for b in batches:
            made = []
            for e, *arrays, many, first in zip(b.column("entity").to_pylist(), *(b.column(c).to_pylist() for c in ("pos", "base", "stratum", "marked", "width", "first")), strict=True):
                positions, start, strata, own = (np.array(x) for x in arrays)
                numbers = np.arange(first + 1, min(draws, first + many) + 1)
                _, codes, size = np.unique(strata, return_inverse=True, return_counts=True)
                k = np.bincount(codes, own)
                seen = close(positions, own[:, None], radii)[:, 0]
                null = close(positions, chosen(start, codes, own, numbers), radii).astype(float)
                for r, o, x in zip(radii, seen.tolist(), null, strict=True):
                    made.append((e, r, int(own.sum()), int((k > 0).sum()), int(k[k < size].sum()), o, first, x.sum(), (x * x).sum(), int((x >= o).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=b.schema.field("entity").type if not i else None) for i, c in enumerate(zip(*made, strict=True))], names=["entity", *names]).cast(pa.schema([("entity", b.schema.field("entity").type), *((n, pa.float64() if n in ("total", "squares") else pa.int32() if n in ("radius", "block") else pa.int64()) for n in names)]))

    parts = blocks.mapInArrow(run, f"entity {kind}, {fields}")
    found = parts.groupBy("entity", "radius", "n_sites", "n_strata", "n_variable", "observed_pairs").agg(*(F.sum(c).alias(c) for c in ("total", "squares", "as_many")))
    possible = (F.col("n_sites") * (F.col("n_sites") - 1) / 2).cast("long")
    found = found.withColumn("possible_pairs", possible)
    m = F.col("total") / draws
    # Sums of whole numbers are exact, and so is the variance's numerator while it is under 2 ** 53.
    variance = F.greatest((F.col("squares") - F.col("total") * m) / max(draws - 1, 1), F.lit(0.0))
    observed = F.col("observed_pairs") / F.col("possible_pairs")
    raw = observed - m / F.col("possible_pairs")
    return found.select(F.col("entity").alias(entity), "radius", "n_sites", "n_strata", "n_variable", "observed_pairs", "possible_pairs", observed.alias("observed"), (m / F.col("possible_pairs")).alias("null_mean"), (F.sqrt(variance) / F.col("possible_pairs")).alias("null_sd"), F.when(F.abs(raw) < 1e-12, 0.0).otherwise(raw).alias("effect"), F.try_divide(observed, m / F.col("possible_pairs")).alias("fold"), ((F.col("as_many") + 1) / (draws + 1.0)).alias("p"))
