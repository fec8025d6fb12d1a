"""Lloyd's clustering of integer vectors, exact, with bounds that geometry loosens less than the centroids' full drift."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm._store import drop, save
from strandlake.llm._text import record_batch

#: Components under this make squared distances that a double holds exactly (dim * (2 * LIMIT) ** 2 < 2 ** 53 up to 128 components); others are computed as Python's integers.
LIMIT = 1 << 22
#: Relative room for the rounding of roots and sums of bounds.
SLACK = 1e-9


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each pair (i, j), how much nearer centroid j's move may have come to any vector in the sphere of `radius` about old centroid i.

    Take the plane through old i, old j and new j, and the line from old j to new j. A vector at angle t to that line, seen from
    old j, has its distance shortened by the integral of the cosine of that angle along the way, and the angle only widens
    on the way, so by drift * cos(t) at most. The sphere spans asin(radius / R) on both sides of its centre's angle, R being the
    distance of the old centroids, and of vectors at these angles the one nearest to the line lies in the plane. So
    drift * cos(angle - asin(radius / R)) bounds it: below the full drift unless the line meets the sphere, and below 0 for a
    centroid that moves away. Where old j is in the sphere the full drift holds.
    """
    k = len(old)
    step = new - old
    drift = np.sqrt((step**2).sum(1))
    out = np.tile(drift, (k, 1))
    for j in np.flatnonzero(drift > 0):
        away = old - old[j]
        far = np.sqrt((away**2).sum(1))
        for i in np.flatnonzero(far > radius * (1 + SLACK)):
            angle = math.acos(float(np.clip(away[i] @ step[j] / (far[i] * drift[j]), -1, 1)))
            out[i, j] = drift[j] * math.cos(max(0.0, angle - math.asin(min(1.0, radius[i] / far[i])) - 1e-7))
    return out


class Move:
    """What a step of the clustering sends to the tasks: the centroids, each one's own drift, and by how much bounds loosen."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None = None, radius: np.ndarray | None = None) -> None:
        self.centroids = centroids
        k = len(centroids)
        if before is None:
            self.own, self.others = np.full(k, np.inf), np.full(k, np.inf)
            return
        old, new = np.array(before, float), np.array(centroids, float)
        self.own = np.sqrt(((new - old) ** 2).sum(1))
        near = loosening(old, new, radius)
        np.fill_diagonal(near, -np.inf)
        self.others = near.max(1) if k > 1 else np.zeros(k)


def squared(v: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances of each vector to each centroid: whole doubles, or Python's integers where components are large."""
    c = np.array(centroids, dtype=object)
    if max(np.abs(v).max(initial=0), max((abs(int(x)) for x in c.ravel()), default=0)) < LIMIT and v.shape[1] <= 128:
        x, y = v.astype(float), c.astype(float)
        return (x**2).sum(1)[:, None] - 2 * (x @ y.T) + (y**2).sum(1)[None, :]
    return np.stack([((v - row) ** 2).sum(1) for row in c], 1)


def assign(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, move: Move, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's cluster, bounds on its distance to that centroid (above) and to all others (below), its exact squared distance if `exact`, and whether it was compared with all centroids.

    A vector keeps its cluster while the bounds say so; else its own distance is computed, and if that is not enough, all of them.
    """
    cluster, own = cluster.copy(), np.zeros(len(v), dtype=object if v.dtype == object else float)
    if not len(v):
        return cluster, upper, lower, own, np.zeros(0, bool)
    known = cluster >= 0
    at = np.maximum(cluster, 0)
    up = np.where(known, upper + move.own[at], np.inf)
    down = np.where(known, lower - move.others[at], -np.inf)
    sure = lambda: up * (1 + SLACK) < down * (1 - SLACK) - SLACK
    ask = np.flatnonzero(known if exact else known & ~sure())
    for i in range(len(move.centroids)):
        here = ask[cluster[ask] == i]
        if len(here):
            own[here] = squared(v[here], [move.centroids[i]])[:, 0]
            up[here] = np.sqrt(own[here].astype(float))
    scan = np.flatnonzero(~sure())
    if len(scan):
        d = squared(v[scan], move.centroids)
        first = np.argmin(d, 1)
        cluster[scan], own[scan] = first, d[np.arange(len(scan)), first]
        up[scan] = np.sqrt(own[scan].astype(float))
        d = d.astype(float)
        d[np.arange(len(scan)), first] = np.inf
        down[scan] = np.sqrt(d.min(1))
    scanned = np.zeros(len(v), bool)
    scanned[scan] = True
    return cluster, up, down, own, scanned


def whole(embedding: Column, dim: int, scale: int) -> Column:
    """floor(scale * x) of each component as long, of vectors with dim components, none null or not finite; else null."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when((F.size(embedding) == dim) & finite, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
    return flat if np.abs(flat).max(initial=0) < LIMIT else flat.astype(object)


def stepped(spark: SparkSession, state: DataFrame, move: Move, dim: int, exact: bool = False) -> DataFrame:
    """state (vec_id, v, cluster, upper, lower) after a step, written; distance is null where no long holds it, or if not `exact`."""
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("distance", pa.int64()), ("scanned", pa.bool_())])

    def run(batches):
        for b in batches:
            v = matrix(b.column("v"), dim)
            before = [b.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower")]
            cluster, up, down, own, scanned = assign(v, *before, move, exact)
            distance = [int(x) if exact and x < 2**63 else None for x in own] if v.dtype == object else own.astype(np.int64) if exact else [None] * len(v)
            yield record_batch(schema, [b.column("vec_id"), b.column("v"), cluster, up, down, distance, scanned])

    return save(spark, state.select("vec_id", "v", "cluster", "upper", "lower").mapInArrow(run, "vec_id long, v array<long>, cluster int, upper double, lower double, distance long, scanned boolean"), "centroids")


def cluster(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, dim: int = 64, scale: int = 64, rounds: int = 3) -> tuple[DataFrame, list[list[int]], list[int]]:
    """(vec_id, cluster, distance) of each kept vector, the final centroids, and how many vectors each step compared with all centroids.

    Vectors with another number of components, or with null, NaN or infinite ones, are left out. Each row counts, repeated
    ones too; a null id is kept. Centroids start as the k rows with the smallest sha256 of `1:<id>` (rows that share an id by their
    components; null ids last); fewer rows make fewer centroids, none an empty result. Ties in distance go to the smaller number.
    Only centroids, counts and sums of k clusters reach the driver.
    """
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole(F.col(vector_col), dim, scale).alias("v")).where("v IS NOT NULL")
    first = kept.orderBy(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    centroids = [list(r["v"]) for r in first]
    state = kept.withColumns({"cluster": F.lit(-1), "upper": F.lit(0.0), "lower": F.lit(0.0)})
    if not centroids:
        return state.select("vec_id", "cluster", F.lit(None).cast("long").alias("distance")), [], []
    move, scanned = Move(centroids), []
    for _ in range(rounds):
        now = stepped(spark, state, move, dim)
        sums = now.groupBy("cluster").agg(F.count("*").alias("n"), F.max("upper").alias("radius"), F.count_if("scanned").alias("scanned"), *(F.sum(F.col("v")[j]).alias(f"c{j}") for j in range(dim))).collect()
        scanned.append(sum(r["scanned"] for r in sums))
        radius, moved = np.zeros(len(centroids)), [list(c) for c in centroids]
        for r in sums:
            radius[r["cluster"]] = r["radius"]
            moved[r["cluster"]] = [r[f"c{j}"] // r["n"] for j in range(dim)]
        move, centroids = Move(moved, centroids, radius), moved
        if len(scanned) > 1:
            drop(spark, state)
        state = now
    now = stepped(spark, state, move, dim, exact=True)
    if rounds:
        drop(spark, state)
    scanned.append(now.where("scanned").count())
    return now.select("vec_id", "cluster", "distance"), centroids, scanned


def assigned(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each kept vector of the embeddings table."""
    found, centroids, _ = cluster(spark, vectors)
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(r["cluster"], r["cluster_inertia"], sum(x["cluster_inertia"] or 0 for x in sums), digest[r["cluster"]]) for r in sums]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(rounds: int = 3, k: int = 16, dim: int = 64, scale: int = 64) -> str:
    """The same in DuckDB: every distance of every round."""
    parts = [
        f"kept AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dim})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS cluster, v FROM kept ORDER BY sha256('1:' || vec_id) NULLS LAST, v LIMIT {k})",
    ]
    for t in range(rounds + 1):
        parts.append(f"a{t} AS (SELECT row, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT k.row, c.cluster, list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM kept k CROSS JOIN c{t} c) GROUP BY row)")
        if t < rounds:
            parts.append(f"m{t} AS (SELECT cluster, list(m ORDER BY i) AS v FROM (SELECT cluster, i, CAST(floor_div AS BIGINT) AS m FROM (SELECT cluster, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div FROM (SELECT a.cluster, unnest(k.v) AS x, unnest(range({dim})) AS i FROM a{t} a JOIN kept k USING (row)) GROUP BY cluster, i)) GROUP BY cluster)")
            parts.append(f"c{t + 1} AS (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{t} c LEFT JOIN m{t} m USING (cluster))")
    return "WITH " + ",\n".join(parts) + f"\nSELECT k.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(list_aggregate(c.v, 'string_agg', ',')) AS centroid_sha256 FROM a{rounds} a JOIN kept k USING (row) JOIN c{rounds} c USING (cluster)"


SQL = _sql()
