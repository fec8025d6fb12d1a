"""Histogram gradient boosting over Spark: many models grow together, one pass over the rows a level of their trees.

Each partition sums gradients by node, feature and bin; sums are whole numbers (gradients in 2**-30), so that they are the same in any order and any
partitioning, and a fit in one process gives the same bits. The driver holds trees, bin edges and the sums of one level: models x nodes x features x bins.
Rows are packed into blocks with their margins, which are written anew after every few trees, so that a pass goes down those few only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.quantiles import exact
from strandlake.sources import files

#: The bin of missing values; others are below.
MISSING = 255
UNIT = float(1 << 30)
#: Levels of score by which average precision is watched for an early stop.
LEVELS = 1024
#: Roles of a row for a model.
OUT, TRAIN, WATCH = 0, 1, 2
#: Rows of a block, and trees after which margins are written.
BLOCK, KEPT = 10_000, 10


@dataclass(frozen=True)
class Boosting:
    """Settings of a booster. l2 is added to hessians; a leaf has `leaf` rows or more; growth ends when average precision on watched rows has not risen for `patience` trees (0: never);
    balanced: both classes get the same total weight."""

    features: tuple[str, ...]
    trees: int = 100
    depth: int = 3
    rate: float = 0.04
    l2: float = 1.0
    leaf: int = 5
    patience: int = 0
    balanced: bool = False


@dataclass
class Model:
    """Complete trees over bins: a node's row goes left if its bin is at most the cut, or missing and `left`. columns: the features' places in a row's bins."""

    how: Boosting
    columns: np.ndarray
    start: float = 0.0
    weight: tuple[float, float] = (1.0, 1.0)
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    left: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    best: tuple[float, int] = (-1.0, 0)
    done: bool = False

    def down(self, bins: np.ndarray, tree: int, depth: int) -> np.ndarray:
        """The place of each row on a level of a tree."""
        flat, first, node = np.ascontiguousarray(bins).reshape(-1), np.arange(len(bins)) * bins.shape[1], np.zeros(len(bins), np.int64)
        column = self.columns[self.feature[tree]]
        right = np.arange(256) > self.cut[tree][:, None]
        right[:, MISSING] = ~self.left[tree]
        right = right.reshape(-1).astype(np.int64)
        for d in range(depth):
            at = node + ((1 << d) - 1)
            node = 2 * node + right.take((at << 8) + flat.take(first + column.take(at)))
        return node

    def margins(self, bins: np.ndarray, trees: int | None = None, held: np.ndarray | None = None) -> np.ndarray:
        """The sums of trees' values, on top of what is held of trees before."""
        out = np.full(len(bins), self.start) if held is None else held.copy()
        for t in range(len(self.value) if trees is None else trees):
            out += self.value[t][self.down(bins, t, self.how.depth)]
        return out

    def since(self, tree: int) -> Model:
        """The model with its trees from this one on."""
        return Model(self.how, self.columns, self.start, self.weight, *(x[tree:] for x in (self.feature, self.cut, self.left, self.value)))

    def scores(self, bins: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-self.margins(bins)))

    def gradients(self, margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, w = 1 / (1 + np.exp(-margins)), np.where(y > 0, self.weight[1], self.weight[0])
        return np.rint(w * (p - y) * UNIT), np.rint(w * p * (1 - p) * UNIT)


def edges(spark: SparkSession, df: DataFrame, features: Sequence[str], bins: int = 63) -> np.ndarray:
    """(features, bins - 1) cuts of each feature between its exact quantiles over all rows; without values all are 0."""
    stacked = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("feature"), number(c).alias("value")) for i, c in enumerate(features)))).alias("s")).select("s.*")
    names = {f"q{k}": k / bins for k in range(1, bins)}
    out = np.zeros((len(features), bins - 1))
    for r in exact(spark, stacked, ["feature"], "value", names).collect():
        out[r["feature"]] = [r[q] for q in names]
    return out


def number(column: str) -> Column:
    """The column as double; NaN is missing, as null is."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def binned(df: DataFrame, id_col: str, label: str, features: Sequence[str], cuts: np.ndarray, more: Sequence[str] = ()) -> DataFrame:
    """(id, y, bins, more): a byte for each feature, the number of cuts below its value, or MISSING."""

    def run(batches):
        for b in batches:
            x = np.stack([b.column(f"f{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))], 1) if len(b) else np.zeros((0, len(features)))
            made = np.stack([np.where(np.isnan(x[:, i]), MISSING, np.searchsorted(cuts[i], x[:, i], "left")) for i in range(len(features))], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "y", *more)), pa.array([r.tobytes() for r in made], pa.binary())], names=["id", "y", *more, "bins"])

    rows = df.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"), *more, *(number(c).alias(f"f{i}") for i, c in enumerate(features)))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: 2 + len(more)])
    return rows.mapInArrow(run, f"{kind}, bins binary")


def split(g: np.ndarray, h: np.ndarray, n: np.ndarray, how: Boosting) -> tuple[float, int, int, bool] | None:
    """(gain, feature, cut, missing goes left) of the best split of one node from sums (features, 256); None if none gains. Ties: the first feature, the least cut, missing to the right."""
    gain = lambda a, b: a * a / (b + how.l2)
    best = None
    for to_left in (False, True):
        ways = []
        for x in (g, h, n):
            below = np.cumsum(x[:, :MISSING], 1)
            ways.append((below + x[:, MISSING:] if to_left else below, x.sum(1)[:, None]))
        (gl, gt), (hl, ht), (nl, nt) = ways
        score = np.where((nl >= how.leaf) & (nt - nl >= how.leaf), gain(gl, hl) + gain(gt - gl, ht - hl) - gain(gt, ht), -np.inf)
        k = int(np.argmax(score))
        if score.flat[k] > 1e-9:
            found = (float(score.flat[k]), -(k // MISSING), -(k % MISSING), not to_left)
            best = max(best or found, found)
    return None if best is None else (best[0], -best[1], -best[2], not best[3])


def _leaf(g: float, h: float, how: Boosting) -> float:
    return -how.rate * g / (h + how.l2)


def grow(model: Model, level: int, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> None:
    """Split the nodes of a level of the last tree by their sums (nodes, features, 256); the last level's children become leaves."""
    how, tree = model.how, len(model.feature) - 1
    for k in range(1 << level):
        at = (1 << level) - 1 + k
        total = (g[k, 0].sum(), h[k, 0].sum())
        found = split(g[k], h[k], n[k], how)
        sides = (total, (0.0, 0.0))
        if found:
            _, f, cut, to_left = found
            model.feature[tree][at], model.cut[tree][at], model.left[tree][at] = f, cut, to_left
            low = [x[k, f, : cut + 1].sum() + (x[k, f, MISSING] if to_left else 0) for x in (g, h)]
            sides = (tuple(low), (total[0] - low[0], total[1] - low[1]))
        if level == how.depth - 1:
            for side, (a, b) in enumerate(sides):
                model.value[tree][2 * k + side] = _leaf(a, b, how)


def precision(pos: np.ndarray, neg: np.ndarray) -> float:
    """Average precision from counts of both kinds by level of score, lowest first."""
    tp, seen = np.cumsum(pos[::-1]), np.cumsum((pos + neg)[::-1])
    return float((pos[::-1] * tp / np.maximum(seen, 1)).sum() / max(pos.sum(), 1))


def _packed(rows: DataFrame, n: int) -> DataFrame:
    """(y, bins, roles, margins) of many rows in one, as bytes; there are no margins yet."""

    def run(batches):
        for b in batches:
            for k in range(0, len(b), BLOCK):
                some = b.slice(k, BLOCK)
                y = some.column("y").to_numpy(zero_copy_only=False).astype(np.int32)
                roles = np.stack(some.column("roles").to_pylist()).astype(np.int8)
                yield pa.RecordBatch.from_pydict({"y": [y.tobytes()], "bins": [b"".join(some.column("bins").to_pylist())], "roles": [roles.T.tobytes()], "margins": [None]}, schema=_BLOCKS)

    parts = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // BLOCK))
    return rows.select("y", "bins", "roles").repartition(max(parts, 1)).mapInArrow(run, "y binary, bins binary, roles binary, margins binary")


_BLOCKS = pa.schema([(c, pa.binary()) for c in ("y", "bins", "roles", "margins")])


def _unpacked(y: bytes, bins: bytes, roles: bytes, margins: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(y, bins, roles, margins) of a block, the last two with a row for each model."""
    y_ = np.frombuffer(y, np.int32)
    return y_, np.frombuffer(bins, np.uint8).reshape(len(y_), -1), np.frombuffer(roles, np.uint8).reshape(-1, len(y_)), None if margins is None else np.frombuffer(margins).reshape(-1, len(y_))


def _kept(blocks: DataFrame) -> RDD:
    """The blocks in memory: a pass is then one small job, without a plan of its own."""
    return blocks.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)


def _advanced(blocks: DataFrame, models: dict[int, Model], n: int) -> DataFrame:
    """The blocks with the margins of n models after the trees that are given of some, for rows that these see."""

    def run(batches):
        for r in (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in _BLOCKS.names), strict=True)):
            y, bins, roles, held = _unpacked(*r)
            margins = np.zeros((n, len(y)))
            for m, model in models.items():
                mine = np.flatnonzero(roles[m] != OUT)
                margins[m, mine] = model.margins(bins[mine], held=None if held is None else held[m, mine])
            yield pa.RecordBatch.from_pydict({"y": [y.tobytes()], "bins": [bins.tobytes()], "roles": [roles.tobytes()], "margins": [margins.tobytes()]}, schema=_BLOCKS)

    return blocks.mapInArrow(run, "y binary, bins binary, roles binary, margins binary")


def _added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two partitions' sums, each as the cells that it has and their values."""
    cells = np.union1d(a[0], b[0])
    out = np.zeros((3, len(cells)), np.int64)
    for some, x in (a, b):
        out[:, np.searchsorted(cells, some)] += x
    return cells, out


def _passed(rows: RDD, models: dict[int, Model], level: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each model, of which the trees since the blocks' margins are given, the sums (nodes, features, 256) of a level of the tree that grows, and at level 0 counts of watched rows by score."""
    size = {m: (1 << level) * len(model.columns) * 256 for m, model in models.items()}
    ends = np.cumsum([n + 2 * LEVELS for n in size.values()])
    place = {m: slice(int(end) - size[m] - 2 * LEVELS, int(end)) for m, end in zip(size, ends, strict=True)}

    def run(blocks):
        whole = np.zeros((3, int(ends[-1])), np.int64)
        for block in blocks:
            y, bins, roles, held = _unpacked(*block)
            for m, model in models.items():
                total, t = whole[:, place[m]], len(model.feature) - 1
                margins = lambda own: model.margins(bins[own], t, None if held is None else held[m, own])  # noqa: B023, E731
                mine = np.flatnonzero(roles[m] == TRAIN)
                if len(mine):
                    own = bins[mine]
                    g, h = model.gradients(margins(mine), y[mine])
                    node = model.down(own, t, level) * (len(model.columns) * 256)
                    for f, c in enumerate(model.columns):
                        cell = node + (own[:, c] + np.int64(f * 256))
                        for i, w in enumerate((g, h, None)):
                            total[i, : size[m]] += np.bincount(cell, w, size[m]).astype(np.int64)
                watched = np.flatnonzero(roles[m] == WATCH)
                if level == 0 and len(watched):
                    p = 1 / (1 + np.exp(-margins(watched)))
                    total[2, size[m] :] += np.bincount(np.minimum((p * LEVELS).astype(np.int64), LEVELS - 1) * 2 + (y[watched] > 0), minlength=2 * LEVELS)
        some = np.flatnonzero(whole[2])
        yield some, whole[:, some]

    cells, sums = rows.mapPartitions(run).treeReduce(_added, 1 if rows.getNumPartitions() <= 16 else 2)
    whole = np.zeros((3, int(ends[-1])))
    whole[:, cells] = sums / np.array([UNIT, UNIT, 1.0])[:, None]
    out = {}
    for m in models:
        x, shape = whole[:, place[m]], (1 << level, len(models[m].columns), 256)
        out[m] = (*(x[i, : size[m]].reshape(shape) for i in range(3)), x[2, size[m] :].reshape(LEVELS, 2))
    return out


def fit(spark: SparkSession, rows: DataFrame, hows: Sequence[Boosting], features: Sequence[str]) -> list[Model]:
    """A model for each of hows over rows (y, bins, roles): roles has a role for each model.

    Rows without a label take no part. A model whose rows are of one kind only scores all rows as that kind, one without rows as 0.
    """
    given = rows.where(F.col("y").isNotNull())
    counts = given.select("y", F.posexplode("roles").alias("model", "role")).where(F.col("role") == TRAIN).groupBy("model").agg(F.count("*").alias("n"), F.sum((F.col("y") > 0).cast("long")).alias("p")).collect()
    seen = {r["model"]: (r["n"], r["p"]) for r in counts}
    models = []
    for m, how in enumerate(hows):
        model = Model(how, np.array([list(features).index(f) for f in how.features]))
        n, p = seen.get(m, (0, 0))
        if not 0 < p < n:
            model.start, model.done = (math.inf if p else -math.inf), True
        elif how.balanced:
            model.weight = (n / (2 * (n - p)), n / (2 * p))
        else:
            model.start = math.log(p / (n - p))
        models.append(model)
    blocks = files.saved(spark, _packed(given, max((n for n, _ in seen.values()), default=0)), "blocks")
    kept, held = _kept(blocks), 0
    for grown in range(max((h.trees for h in hows), default=0) + 1):
        if grown - held == KEPT and not all(x.done for x in models):
            made = files.saved(spark, _advanced(blocks, {i: x.since(held) for i, x in enumerate(models) if not x.done}, len(models)), "blocks")
            kept.unpersist()
            files.drop(spark, blocks)
            blocks, kept, held = made, _kept(made), grown
        for model in models:
            if not model.done:
                k = 1 << model.how.depth
                model.feature.append(np.zeros(k - 1, int)), model.cut.append(np.full(k - 1, MISSING)), model.left.append(np.ones(k - 1, bool)), model.value.append(np.zeros(k))
        for level in range(max(h.depth for h in hows)):
            open_ = [i for i, x in enumerate(models) if not x.done and level < x.how.depth]
            if not open_:
                break
            for m, (g, h, n, watched) in _passed(kept, {i: models[i].since(held) for i in open_}, level).items():
                model, t = models[m], len(models[m].value) - 1
                if level == 0:
                    ap = precision(watched[:, 1], watched[:, 0])
                    if ap > model.best[0]:
                        model.best = (ap, t)
                    stop = model.how.patience and watched[:, 1].any() and t - model.best[1] >= model.how.patience
                    if stop or t == model.how.trees:
                        keep = model.best[1] if stop else t
                        model.feature, model.cut, model.left, model.value = (x[:keep] for x in (model.feature, model.cut, model.left, model.value))
                        model.done = True
                        continue
                grow(model, level, g, h, n)
    kept.unpersist()
    files.drop(spark, blocks)
    return models


def scored(rows: DataFrame, models: list[Model], which: Column) -> DataFrame:
    """(id, y, model, score) for each row and each model of the array `which`."""
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        for b in batches:
            bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(len(b), -1) if len(b) else np.zeros((0, 1), np.uint8)
            lists = b.column("which").to_pylist()
            for m in sorted({m for x in lists for m in x}):
                at = np.array([i for i, x in enumerate(lists) if m in x])
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), b.column("y").take(pa.array(at)), pa.array([m] * len(at), pa.int32()), pa.array(models[m].scores(bins[at]))], names=["id", "y", "model", "score"])

    return rows.select("id", "y", "bins", which.alias("which")).mapInArrow(run, f"id {kind}, y int, model int, score double")
