"""Centroid clustering with the exponion search: each vector carries an upper bound of the distance to its centroid and a lower bound of
the distance to any other; where the bounds do not settle it, only centroids inside a ball around its current centroid are scanned.

The ball: with s the distance from centroid a to its nearest other centroid and u the distance from a vector to a, every centroid that is
at most as far as a, and the nearest of the others, is within 2 u + s of a. Each centroid has a list of the others by distance, so the
ball is a prefix of its list. The radius is inclusive, and bounds that are equal settle nothing: ties are always scanned and go to the smaller
number. Distances that decide are exact 64-bit integers; bounds are floats with a slack that covers their rounding.

Each round is one pass over the rows (numpy inside tasks, a block of rows at a time) that writes vectors, clusters and bounds, and one
aggregate of sums and counts with map-side combining, whose k rows go to the driver and come back as the next centroids. No row is
shuffled. Sums and floors are exact.

Rows: vectors that are null, have another length, or a null or non-finite component are left out; so are those with a component of 2**20
or more in size, as their squared distances might not fit into a long. Components are floor(scale * x). Ids may repeat or be null: such
rows are vectors of their own; a null id is drawn as a start last. Fewer vectors than k give as many centroids; equal starts stay, the
smaller number has the vectors. An empty table gives an empty result; extra columns are not read."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import Scratch

SLACK = 1e-9
MOST = float(1 << 20)


def finite(vector: Column, dims: int) -> Column:
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < MOST))
    return F.coalesce((F.size(vector) == dims) & fits, F.lit(False))


def squared(block: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = block - centroid
    return np.einsum("ij,ij->i", gap, gap)


class Ball:
    """For each centroid the others by distance, and how far the nearest is."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        gaps = np.sqrt(np.array([squared(centroids, c) for c in centroids], np.float64).reshape(len(centroids), -1))
        np.fill_diagonal(gaps, -1)  # itself stands first
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.sorted = np.take_along_axis(gaps, self.order, axis=1)
        self.nearest = self.sorted[:, 1] if len(centroids) > 1 else np.full(len(centroids), np.inf)


def assign(block: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, ball: Ball):
    """(cluster, upper bound, lower bound, distances computed) after one search; inputs are those of the round before with moved bounds."""
    cluster, upper, lower, scanned = cluster.copy(), upper.copy(), lower.copy(), np.zeros(len(block), np.int64)
    limit = np.maximum(lower, ball.nearest[cluster] / 2 * (1 - SLACK))
    open_ = np.flatnonzero(upper >= limit)
    # The distance to the own centroid may settle it.
    own = np.zeros(len(block), np.int64)
    for a in np.unique(cluster[open_]):
        rows = open_[cluster[open_] == a]
        own[rows] = squared(block[rows], ball.centroids[a])
    scanned[open_] += 1
    upper[open_] = np.sqrt(own[open_]) * (1 + SLACK)
    open_ = open_[upper[open_] >= limit[open_]]
    before = cluster[open_]
    for a in np.unique(before):
        rows = open_[before == a]
        radius = (2 * upper[rows] + ball.nearest[a]) * (1 + SLACK)
        reach = np.searchsorted(ball.sorted[a], radius, "right")
        best, number, second = own[rows].copy(), np.full(len(rows), a), np.full(len(rows), np.iinfo(np.int64).max)
        for place in range(1, int(reach.max(initial=1))):
            j = ball.order[a, place]
            use = np.flatnonzero(reach > place)
            d = squared(block[rows[use]], ball.centroids[j])
            scanned[rows[use]] += 1
            wins = (d < best[use]) | ((d == best[use]) & (j < number[use]))
            second[use] = np.where(wins, best[use], np.minimum(second[use], d))
            won = use[wins]
            best[won], number[won] = d[wins], j
        cluster[rows], upper[rows] = number, np.sqrt(best) * (1 + SLACK)
        # Outside the ball nothing is nearer than the nearest other centroid can be.
        lower[rows] = np.where(second == np.iinfo(np.int64).max, np.inf, np.sqrt(second.astype(np.float64)) * (1 - SLACK))
    return cluster, upper, lower, scanned


STATE = "cluster int, upper double, lower double, scanned long"


def _round(centroids: np.ndarray, moved: np.ndarray | None, rows: int = 1 << 13):
    """One search; `moved` says how far each centroid went since the bounds were made, None where there are no bounds yet."""

    def run(batches):
        import pyarrow as pa

        ball = Ball(centroids)
        if moved is not None:
            order = np.sort(moved)
            farthest = np.where(moved == order[-1], order[-2] if len(order) > 1 and (moved == order[-1]).sum() == 1 else order[-1], order[-1])
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, rows):
                batch = whole_batch.slice(at, rows)
                block = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
                if moved is None:
                    cluster, upper, lower = np.zeros(len(block), np.int64), np.full(len(block), np.inf), np.zeros(len(block))
                else:
                    cluster = batch.column(2).to_numpy().astype(np.int64)
                    upper = (batch.column(3).to_numpy() + moved[cluster]) * (1 + SLACK)
                    lower = np.maximum(batch.column(4).to_numpy() - farthest[cluster], 0) * (1 - SLACK)
                cluster, upper, lower, scanned = assign(block, cluster, upper, lower, ball)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(scanned)], ["vec_id", "v", "cluster", "upper", "lower", "scanned"])

    return run


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:id`; of equal hashes the smaller vector first."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = vectors.select(digest.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in found], np.int64)


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: floor of the mean of each cluster, the old one where it is empty."""
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(centroids.shape[1])]
    return out


def cluster(frame: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, scanned (distances computed
    for it in the last search)."""
    spark, scratch = frame.sparkSession, Scratch(frame.sparkSession, "exponion")
    whole = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))
    vectors = scratch.write(frame.where(finite(F.col(vector_col), dims)).select(F.col(id_col).alias("vec_id"), whole.alias("v")), "vectors")
    kind = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, v array<int>, {STATE}"
    centroids = starts(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scanned long")
    state, moved = vectors, None
    for i in range(rounds + 1):
        state = scratch.write(state.mapInArrow(_round(centroids, moved), kind), f"round-{i}")
        if i:
            scratch.drop(f"round-{i - 1}")
        if i == rounds:
            break
        next_ = _moved(state, centroids)
        moved, centroids = np.sqrt(np.array([squared(n[None], c)[0] for n, c in zip(next_, centroids, strict=True)], np.float64)) * (1 + SLACK), next_
    final = {i: c for i, c in enumerate(centroids.tolist())}
    table = spark.createDataFrame([(i, c, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in final.items()], "cluster int, centroid array<long>, centroid_sha256 string")
    gaps = F.zip_with("v", "centroid", lambda a, b: (a - b) * (a - b))
    told = state.join(F.broadcast(table), "cluster").withColumn("distance", F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x))
    sums = told.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    total = sum(r.cluster_inertia for r in sums)
    sums = spark.createDataFrame([tuple(r) for r in sums], "cluster int, cluster_inertia long")
    return told.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256", "scanned")
