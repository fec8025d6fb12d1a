"""Matched controls over whole tables, and maximum matchings within small groups."""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators.draws import base
from strandlake.sources import files


def stable_seed(base: int, *parts: object) -> int:
    """A seed from a base and tokens, the same in every partitioning."""
    return (base + int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)) % (1 << 32)


def standardised(rows: DataFrame, covariates: Sequence[str], logs: Sequence[str] = ()) -> DataFrame:
    """rows with each covariate as its distance from the mean in deviations (of the population; 1 where none varies); log10(x + 1) first for those in `logs`. One row of means is joined to all."""
    value = lambda c: F.log10(F.col(c).cast("double") + 1) if c in logs else F.col(c).cast("double")
    about = rows.agg(*(F.avg(value(c)).alias(f"m_{c}") for c in covariates), *(F.coalesce(F.nullif(F.stddev_pop(value(c)), F.lit(0.0)), F.lit(1.0)).alias(f"d_{c}") for c in covariates))
    made = rows.crossJoin(F.broadcast(about)).withColumns({c: (value(c) - F.col(f"m_{c}")) / F.col(f"d_{c}") for c in covariates})
    return made.drop(*(f"{k}_{c}" for k in "md" for c in covariates))


def in_reach(cases: DataFrame, donors: DataFrame, grid: Sequence[str], reach: float, more: Sequence[str] = (), box: bool = True, seed: int = 42) -> DataFrame:
    """(case, donor, distance, tie) of the pairs in reach: differences of at most `reach` in every covariate (box), or a summed square of at most its square.

    cases and donors have id, the covariates of `grid` and those of `more`. Both meet in cells as wide as the reach over `grid`, a case in the cells around its own too, so that work grows
    with near pairs. Rows without an id or a covariate of `grid` go; a missing one of `more` adds nothing. tie is a hash of seed and donor, which orders equal distances.
    """
    cell = lambda c: F.floor(F.col(c) / (reach * (1 + 1e-9))).cast("long")  # noqa: E731  a little wider, since quotients are rounded
    named = lambda rows, p: rows.select(F.col("id").alias(f"{p}_id"), *(F.col(c).alias(f"{p}_{c}") for c in (*grid, *more)), *(cell(c).alias(f"_{i}") for i, c in enumerate(grid))).dropna(subset=[f"{p}_id", *(f"{p}_{c}" for c in grid)])
    a, b = named(cases, "a"), named(donors, "b")
    for i in range(len(grid)):
        a = a.withColumn("_s", F.explode(F.array(*(F.lit(s) for s in (-1, 0, 1))))).withColumn(f"_{i}", F.col(f"_{i}") + F.col("_s")).drop("_s")
    far = {c: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in (*grid, *more)}
    distance = sum((F.coalesce(far[c] * far[c], F.lit(0.0)) for c in (*grid, *more)), F.lit(0.0))
    pairs = a.join(b, [f"_{i}" for i in range(len(grid))]).withColumn("distance", distance)
    near = functools.reduce(lambda x, y: x & y, (F.coalesce(far[c] <= reach, F.lit(True)) for c in far)) if box else F.col("distance") <= reach * reach
    return pairs.where(near).select(F.col("a_id").alias("case"), F.col("b_id").alias("donor"), "distance", base(seed, "b_id").alias("tie"))


def _settle(spark: SparkSession, live: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """live (case, donor, distance, tie, rank) without the pairs that a better case's claim rules out, and each donor's claim (donor, held), when no claim moves any more.

    Each case claims its `most` nearest donors, each donor keeps the case of least rank, and pairs of a donor with cases of greater rank than the kept one
    go: they could never hold it, as claims only improve. This is deferred acceptance; as all donors rank cases alike its outcome is that of serving
    cases one by one. A round is two shuffles of the pairs left.
    """
    nearest = W.partitionBy("case").orderBy("distance", "tie", "donor")
    now = files.saved(spark, live, "claims")
    while True:
        claims = now.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= most)
        held = claims.groupBy("donor").agg(F.min("rank").alias("held"), F.count("*").alias("claims"))
        held = files.saved(spark, held, "held")
        if held.where("claims > 1").isEmpty():
            return now, held.drop("claims")
        new = files.saved(spark, now.join(held, "donor", "left").where("held IS NULL OR rank <= held").drop("held", "claims"), "claims")
        files.drop(spark, now)
        files.drop(spark, held)
        now = new


def serve(spark: SparkSession, candidates: DataFrame, ranks: DataFrame, most: int = 1) -> DataFrame:
    """(case, donor, distance): cases in the order of `ranks` (case, rank) each take their `most` nearest candidates that are still free.

    The result is exactly that of going through the cases one by one, with ties in distance by tie and then by donor; ranks must differ. No task holds
    more than the pairs of a case or of a donor.
    """
    live, _ = _settle(spark, candidates.join(ranks.select("case", "rank"), "case"), most)
    n = F.row_number().over(W.partitionBy("case").orderBy("distance", "tie", "donor"))
    return live.withColumn("_n", n).where(F.col("_n") <= most).select("case", "donor", "distance")


#: Donors of a part of space, about; a task holds one part's at a time. Beyond PARTS parts they grow instead, since every task gets all parts' bounds.
PART, PARTS = 8000, 4096
#: Rows that a turn across leaves asks for beyond those wanted.
ANSWERS = 4_000_000
_FREE = 1 << 62  # over every place in the order: what a free donor is held by


def _parts(sample: np.ndarray, most: int, at: float) -> list[tuple[int, float, int, int]]:
    """A tree of splits (covariate, value, node below, node from it on; covariate -1: a leaf) that halves the sample along its widest covariate, `at` of its rows below."""
    tree: list = [None]
    todo = [(0, sample, most)]
    while todo:
        node, x, n = todo.pop()
        width = x.max(0) - x.min(0) if len(x) else np.zeros(1)
        if n < 2 or len(x) < 2 or width.max() == 0:
            tree[node] = (-1, 0.0, node, node)
            continue
        d = int(width.argmax())
        value = np.sort(x[:, d])[int(len(x) * at)]
        if value == x[:, d].min():
            value = x[x[:, d] > value, d].min()
        below = x[:, d] < value
        tree[node] = (d, float(value), len(tree), len(tree) + 1)
        todo += [(len(tree), x[below], n // 2), (len(tree) + 1, x[~below], n - n // 2)]
        tree += [None, None]
    return tree


def _leaf(tree: list, x: np.ndarray) -> np.ndarray:
    d, value, low, high = (np.array(c) for c in zip(*tree, strict=True))
    node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    while (d[node] >= 0).any():
        node = np.where(x[rows, np.maximum(d[node], 0)] < value[node], low[node], high[node])
    return node


class _Space:
    """Where donors are: of each leaf the bounds of its donors, the greatest place that holds one, and how many are free."""

    def __init__(self, found: list, n_grid: int, reach: float | None):
        self.leaf = np.array([f["leaf"] for f in found], dtype=np.int64)
        self.held, self.free = (np.array([f[k] for f in found], dtype=np.int64) for k in ("held", "free"))
        n = (len(found[0]) - 3) // 2 if found else 0
        self.low, self.high = (np.array([[np.nan if (v := f[f"{k}{i}"]) is None else v for i in range(n)] for f in found]).reshape(len(found), n) for k in ("l", "h"))
        self.n_grid, self.reach = n_grid, reach

    def near(self, c: np.ndarray, place: int) -> np.ndarray:
        """Of each leaf the least summed square of c to its donors; infinite where none may be had by that place. Rounding is monotone, so no donor is nearer."""
        at, g = c[: self.n_grid], self.n_grid
        off = np.maximum(np.maximum(self.low[:, :g] - at, at - self.high[:, :g]), 0.0)
        out = _summed(off)
        out[self.held <= place] = np.inf
        if self.reach is not None:
            out[(off > self.reach).any(1)] = np.inf
        return out

    def visits(self, c: np.ndarray, place: int, most: int) -> np.ndarray:
        """The leaves that may have one of the `most` nearest donors that the place may have."""
        near = self.near(c, place)
        off = np.fmax(np.abs(self.low - c), np.abs(self.high - c))
        far, free = _summed(off), self.free
        if self.reach is not None:
            free = np.where((np.nan_to_num(off) <= self.reach).all(1), free, 0)
        order = np.argsort(far)
        enough = np.searchsorted(np.cumsum(free[order]), most)
        limit = far[order[enough]] if enough < len(order) else np.inf
        return self.leaf[(near <= limit) & (near < np.inf)]


def _summed(off: np.ndarray) -> np.ndarray:
    """Squares summed from the first covariate to the last, as in_reach() does; missing ones add nothing."""
    out = np.zeros(len(off))
    for i in range(off.shape[1]):
        out += np.nan_to_num(off[:, i]) ** 2
    return out


def _distances(x: np.ndarray, c: np.ndarray, reach: float | None) -> np.ndarray:
    off = np.abs(x - c)
    out = _summed(off)
    if reach is not None:
        out[(off > reach).any(1)] = np.inf
    return out


def _serve_leaf(held: np.ndarray, x: np.ndarray, hx: np.ndarray, wanting: list, leaf: int, space: _Space) -> list:
    """Lets the wanting (place, n, covariates) take the leaf's donors (sorted by tie and id), as long as no other leaf can have a nearer one, and those who lose one take others; gives back who still wants.

    held and hx, the places that hold donors and their covariates, are brought up to date.
    """
    elsewhere = space.leaf != leaf
    heap = [(int(p), i, int(n), c) for i, (p, n, c) in enumerate(wanting)]
    heapq.heapify(heap)
    count, left = len(heap), []
    while heap:
        place, _, n, c = heapq.heappop(heap)
        limit = space.near(c, place)[elsewhere].min(initial=np.inf)
        d = _distances(x, c, space.reach)
        d[held <= place] = np.inf
        while n:
            j = int(d.argmin())
            if d[j] == np.inf or d[j] >= limit:
                break
            if held[j] < _FREE:
                heapq.heappush(heap, (int(held[j]), count, 1, hx[j].copy()))
                count += 1
            held[j], hx[j], d[j] = place, c, np.inf
            n -= 1
        if n and (limit < np.inf or d.min() < np.inf):
            left.append((place, n, c))
    return left


def serve_near(spark: SparkSession, cases: DataFrame, donors: DataFrame, grid: Sequence[str], more: Sequence[str] = (), most: int = 1, reach: float | None = None, seed: int = 42) -> DataFrame:
    """(case, donor, distance): cases (id, rank, covariates) in order of rank each take their `most` nearest donors (id, covariates) that are still free, within `reach` in every covariate if given.

    As serve() over all pairs in reach, but no pairs are made. Donors are dealt to leaves of a tree over `grid`, fitted on a sample. In a leaf's task cases claim their nearest donor while no other
    leaf can have a nearer one, a donor keeps the claim of least rank, and who lost goes on; claims may come in any order, since all donors rank cases alike (deferred acceptance). Two trees with
    other borders take turns. Those near borders of both, or with little left around them, ask all leaves that may have their donors; cases of equal covariates ask once and share the answer in
    their order. Distances are summed squares, ties go by a hash of seed and donor. Rows with null ids or null covariates of `grid` go; a missing one of `more` adds nothing.
    """
    names, g = [*grid, *more], len(grid)
    xs, hs = [f"x{i}" for i in range(len(names))], [f"h{i}" for i in range(len(names))]
    row = lambda rows, *keep: rows.dropna(subset=["id", *grid]).select("id", *keep, *(F.col(c).cast("double").alias(x) for c, x in zip(names, xs, strict=True)))
    people = files.saved(spark, row(cases, "rank").orderBy("rank").withColumn("place", F.monotonically_increasing_id()).drop("rank"), "cases")
    known = row(donors)
    n = known.count()
    leaves = min(PARTS, max(1, round(n / PART)))
    sample = known.select(*xs[:g]).sample(min(1.0, 64 * leaves / n) if n else 1.0, 1).toPandas().to_numpy(dtype=float)
    trees = [_parts(sample, leaves, at) for at in (0.5, 0.37)]
    kinds = ", ".join(f"{x} double" for x in xs)

    def dealt(batches):
        for b in batches:
            yield b.assign(**{f"leaf{k}": _leaf(t, b[xs[:g]].to_numpy(dtype=float)) for k, t in enumerate(trees)})

    state = f"id long, tie long, {kinds}, leaf0 long, leaf1 long, held long, {', '.join(f'{h} double' for h in hs)}"
    now = known.withColumn("id", F.col("id").cast("long")).withColumn("tie", base(seed, "id")).mapInPandas(dealt, f"id long, {kinds}, tie long, leaf0 long, leaf1 long")
    now = now.select("*", F.lit(_FREE).alias("held"), *(F.lit(None).cast("double").alias(h) for h in hs)).select(*[c.split()[0] for c in state.split(", ")])
    now = files.saved(spark, now, "donors")
    wanting = people.select("place", F.lit(most).cast("long").alias("n"), *xs)
    turn, before = 0, None
    while n:
        key = f"leaf{turn % 2}"
        bounds = [a for i, x in enumerate(xs) for a in (F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}"))]
        space = _Space(now.groupBy(F.col(key).alias("leaf")).agg(F.max("held").alias("held"), F.count_if(F.col("held") == _FREE).alias("free"), *bounds).collect(), g, reach)
        if turn % 3 == 2:
            new, left = _claim_near(spark, now, wanting, key, space, xs, hs, state, most)
        else:
            new, left = _claim_leaf(spark, now, wanting, key, trees[turn % 2], space, xs, hs, state)
        old, now = now, new
        left = files.saved(spark, left.groupBy("place").agg(F.sum("n").alias("n"), *(F.first(x).alias(x) for x in xs)), "wanting")
        files.drop(spark, old)
        if before is not None:
            files.drop(spark, before)
        wanting = before = left
        if left.isEmpty():
            break
        turn += 1
    off = [F.abs(F.col(h) - F.col(x)) for h, x in zip(hs, xs, strict=True)]
    distance = sum((F.coalesce(o * o, F.lit(0.0)) for o in off), F.lit(0.0))
    got = now.where(F.col("held") < _FREE).select(F.col("id").alias("donor"), F.col("held").alias("place"), distance.alias("distance"))
    return got.join(people.select(F.col("id").alias("case"), "place"), "place").select("case", "donor", "distance")


def _claim_leaf(spark: SparkSession, now: DataFrame, wanting: DataFrame, key: str, tree: list, space: _Space, xs: list, hs: list, state: str) -> tuple[DataFrame, DataFrame]:
    """A turn within leaves: donors as they are held then, and who still wants (place, n, covariates)."""
    g, columns = space.n_grid, [c.split()[0] for c in state.split(", ")]

    def dealt(batches):
        for b in batches:
            yield b.assign(leaf=_leaf(tree, b[xs[:g]].to_numpy(dtype=float)))

    def one(k: tuple, d: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["tie", "id"], ignore_index=True)
        x, hx = d[xs].to_numpy(dtype=float, copy=True), d[hs].to_numpy(dtype=float, copy=True)
        held = d["held"].to_numpy(dtype=np.int64, copy=True)
        rows = list(zip(w["place"], w["n"], w[xs].to_numpy(dtype=float), strict=True))
        left = _serve_leaf(held, x, hx, rows, k[0], space) if len(d) else rows
        d["held"], d[hs] = held, hx
        d["place"], d["n"] = pd.array([None] * len(d), dtype="Int64"), pd.array([None] * len(d), dtype="Int64")
        lost = pd.DataFrame([(p, n, *c) for p, n, c in left], columns=["place", "n", *xs])
        return pd.concat([d[[*columns, "place", "n"]], lost.reindex(columns=[*columns, "place", "n"])]) if len(lost) else d[[*columns, "place", "n"]]

    kinds = ", ".join(f"{x} double" for x in xs)
    asked = wanting.select("place", "n", *xs).mapInPandas(dealt, f"place long, n long, {kinds}, leaf long")
    made = now.groupBy(key).cogroup(asked.groupBy("leaf")).applyInPandas(one, f"{state}, place long, n long")
    made = files.saved(spark, made, "turn")
    return made.where("place IS NULL").select(*columns), made.where("place IS NOT NULL").select("place", "n", *xs)


def _chase(c: np.ndarray, them: list, d: pd.DataFrame, whole: bool, chase: bool, xs: list, hs: list, reach: float | None) -> list[tuple]:
    """Claims (place, donor, covariates) among d, the donors nearest to c in order (whole: all of them), of those at c and, as far as surely nobody beyond d is nearer, of those they put out; and, without a donor, who took part and may want more."""
    held, ids, x, hx = d["held"].to_numpy(dtype=np.int64, copy=True), d["id"].to_numpy(), d[xs].to_numpy(dtype=float), d[hs].to_numpy(dtype=float, copy=True)
    far, first = d["far"].to_numpy(dtype=float), np.empty(len(d), dtype=np.int64)
    first[np.lexsort((ids, d["tie"].to_numpy()))] = np.arange(len(d))
    ball = min(np.inf if whole else far[-1], np.inf if reach is None else reach * reach)
    heap, moved, part = [(one["place"], i, one["n"], c) for i, one in enumerate(them)], set(), {}
    heapq.heapify(heap)
    count = len(heap)
    while heap:
        place, i, n, at = heapq.heappop(heap)
        here = i < len(them)
        if not here and not chase:
            part[place] = at
            continue
        mine = far.copy() if here else _distances(x, at, reach)
        mine[held <= place] = np.inf
        limit = np.inf if here else max(0.0, ball**0.5 - float(_summed((at - c)[None])[0]) ** 0.5) ** 2 * (1 - 1e-9)
        while n and len(mine) and (least := mine.min()) < limit:
            same = np.flatnonzero(mine == least)
            j = same[first[same].argmin()]
            if held[j] < _FREE:
                heapq.heappush(heap, (int(held[j]), count, 1, hx[j].copy()))
                count += 1
            held[j], hx[j], mine[j] = place, at, np.inf
            moved.add(int(j))
            n -= 1
        if not (n and here and whole):  # nothing is left for those for whom d has all
            part[place] = at
    return [(int(held[j]), int(ids[j]), *hx[j]) for j in moved] + [(place, None, *at) for place, at in part.items()]


def _claim_near(spark: SparkSession, now: DataFrame, wanting: DataFrame, key: str, space: _Space, xs: list, hs: list, state: str, most: int) -> tuple[DataFrame, DataFrame]:
    """A turn across leaves: those who want, one row for all of equal covariates, ask the leaves that may have their donors, and some ANSWERS / (rows) more, among which those they put out find others.

    Each donor keeps the claim of least place. Every claim is due whatever other tasks find meanwhile, since those who refused it were of lesser place; how many a case lacks is counted afterwards.
    """
    kinds, columns, reach = ", ".join(f"{x} double" for x in xs), [c.split()[0] for c in state.split(", ")], space.reach
    chase = space.n_grid == len(xs)  # covariates that may be missing make no metric
    alike = files.saved(spark, wanting.groupBy(*xs).agg(F.min("place").alias("first"), F.sum("n").alias("most"), F.sort_array(F.collect_list(F.struct("place", "n"))).alias("them")), "alike")
    more = min(4000, ANSWERS // max(1, alike.count()))
    rows = alike.withColumn("most", F.col("most") + more)

    def ask(batches):
        for b in batches:
            at = [space.visits(c, p, m) for c, p, m in zip(b[xs].to_numpy(dtype=float), b["first"], b["most"], strict=True)]
            yield b.loc[b.index.repeat([len(a) for a in at])].assign(leaf=np.concatenate([*at, np.zeros(0, dtype=np.int64)]).astype(np.int64))

    given = ["first", "id", "tie", "held", "far", *xs, *hs]

    def answer(k: tuple, d: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["tie", "id"], ignore_index=True)
        x, held, out = d[xs].to_numpy(dtype=float), d["held"].to_numpy(), []
        for c, first, n in zip(w[xs].to_numpy(dtype=float), w["first"], w["most"], strict=True):
            far = _distances(x, c, reach)
            far[held <= first] = np.inf
            near = np.flatnonzero(far < np.inf)
            if len(near) > n:
                near = near[far[near] <= np.partition(far[near], n - 1)[n - 1]]
            near = near[np.argsort(far[near], kind="stable")[:n]]
            out.append(d.iloc[near].assign(first=first, far=far[near])[given])
        return pd.concat(out) if out else pd.DataFrame(columns=given)

    def share(k: tuple, a: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        n = int(w["most"].iloc[0])
        a = a.sort_values(["far", "tie", "id"], ignore_index=True)[:n]
        out = _chase(w[xs].to_numpy(dtype=float)[0], list(w["them"].iloc[0]), a, len(a) < n, chase, xs, hs, reach)
        return pd.DataFrame(out, columns=["place", "donor", *xs]).astype({"donor": "Int64"})

    asked = rows.select("first", "most", *xs).mapInPandas(ask, f"first long, most long, {kinds}, leaf long")
    busy = now.join(F.broadcast(asked.select(F.col("leaf").alias(key)).distinct()), key, "left_semi").select("id", "tie", "held", key, *xs, *hs)
    found = busy.groupBy(key).cogroup(asked.groupBy("leaf")).applyInPandas(answer, f"first long, id long, tie long, held long, far double, {kinds}, {', '.join(f'{h} double' for h in hs)}")
    claims = files.saved(spark, found.groupBy("first").cogroup(rows.groupBy("first")).applyInPandas(share, f"place long, donor long, {kinds}"), "claims")
    best = claims.where("donor IS NOT NULL").groupBy(F.col("donor").alias("id")).agg(F.min("place").alias("won"), *(F.min_by(x, "place").alias(f"w{x}") for x in xs))
    made = now.join(best, "id", "left").select(*[F.coalesce("won", "held").alias("held") if c == "held" else F.when(F.col("won").isNotNull(), F.col(f"wx{c[1:]}")).otherwise(F.col(c)).alias(c) if c in hs else F.col(c) for c in columns])
    new = files.saved(spark, made, "turn")
    part = claims.where("donor IS NULL").groupBy("place").agg(*(F.first(x).alias(x) for x in xs))
    has = new.join(F.broadcast(part.select(F.col("place").alias("held"))), "held", "left_semi").groupBy(F.col("held").alias("place")).agg(F.count("*").alias("has"))
    return new, part.join(has, "place", "left").select("place", (most - F.coalesce("has", F.lit(0))).alias("n"), *xs).where("n > 0")


def greedy_match(spark: SparkSession, cases: DataFrame, donors: DataFrame, grid: Sequence[str], more: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """(case, donor, distance): cases (id, rank, covariates) in order of rank each take the nearest donor (id, covariates) that is still free, however far. Ranks are numbers or structs, and differ.

    Cases that find no free donor have no row; nor do rows with null ids or null covariates of `grid`.
    """
    return serve_near(spark, cases, donors, grid, more, seed=seed)


def matched(near: dict) -> int:
    """The most left items that can have a right item of their own (near: left to right items), by augmenting paths, breadth first, so that long ones need no deep recursion."""
    owner: dict = {}
    n = 0
    for start in near:
        came, queue, end = {}, [start], None
        for a in queue:
            for b in near[a]:
                if b not in came:
                    came[b] = a
                    if b not in owner:
                        end = b
                        break
                    queue.append(owner[b])
            if end is not None:
                break
        if end is None:
            continue
        n += 1
        mine = {a: b for b, a in owner.items()}
        while end is not None:
            a = came[end]
            owner[end], end = a, mine.get(a)
    return n


def maximum_matching(edges: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """(keys, matched): for each group, the most left items that can have a right item of their own.

    A group is one island of sites, which a chain of gaps bounds; its distinct edges are one row, and a call of Python takes a batch of groups.
    """
    kinds = ", ".join(f"`{k}` {edges.schema[k].dataType.simpleString()}" for k in keys)
    groups = edges.select(*keys, left, right).dropna().groupBy(*keys).agg(F.collect_set(F.struct(F.col(left).alias("a"), F.col(right).alias("b"))).alias("_edges"))

    def run(batches):
        for b in batches:
            made = []
            for own, other in zip(b.column("_left").to_pylist(), b.column("_right").to_pylist(), strict=True):
                near: dict = {}
                for x, y in zip(own, other, strict=True):
                    near.setdefault(x, []).append(y)
                made.append(matched(near))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(made, pa.int64())], names=[*keys, "matched"])

    return groups.select(*keys, F.col("_edges.a").alias("_left"), F.col("_edges.b").alias("_right")).mapInArrow(run, f"{kinds}, matched long")
