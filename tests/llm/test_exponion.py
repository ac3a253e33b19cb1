"""Exponion search against plain k-means in integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.llm import exponion


def brute(rows, k, rounds, dims, scale=64, seed=1):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda v: min(range(len(centroids)), key=lambda j: (far(v, centroids[j]), j))
    for _ in range(rounds):
        at = [place(v) for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = [place(v) for _, v in kept]
    d = [far(v, centroids[a]) for (_, v), a in zip(kept, at, strict=True)]
    inertia = {j: sum(x for x, a in zip(d, at, strict=True) if a == j) for j in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, a, x, inertia[a], sum(d), sha[a]) for (i, _), a, x in zip(kept, at, d, strict=True)), key=repr)


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("case", ["spread", "ties", "few", "odd"])
def test_equals_plain_search(spark, case):
    random = np.random.default_rng(5)
    if case == "spread":
        rows = [(i, (random.normal(size=4) + 3 * (i % 5)).tolist()) for i in range(400)]
    elif case == "ties":  # a small grid: most vectors are as far from several centroids
        rows = [(i, [float(x) / 64 for x in random.integers(0, 3, 4)]) for i in range(300)]
    elif case == "few":
        rows = [(i, [float(i), 0.5, 0.0, -1.0]) for i in range(3)]
    else:
        rows = [(1, [1.0, 2.0, 3.0, 4.0])] * 3 + [(None, [-1.5, 0.0, 0.0, 0.1]), (2, None), (3, [1.0]), (4, [1.0, None, 0.0, 0.0]), (5, [float("nan"), 0.0, 0.0, 0.0]), (6, [float("inf"), 0.0, 0.0, 0.0]), (7, [-0.001, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash")).repartition(3)
    got = [tuple(r) for r in exponion.cluster(frame, k=7, dims=4).select(COLUMNS).collect()]
    assert sorted(got, key=repr) == brute(rows, 7, 3, 4)


def test_empty_table(spark):
    assert exponion.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).columns[:6] == COLUMNS
    assert exponion.cluster(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_the_ball_leaves_centroids_out():
    """Clusters that lie apart are scanned in part, with the result of a full scan."""
    random = np.random.default_rng(7)
    middles = random.integers(-2000, 2000, (16, 8))
    block = (middles[np.arange(4000) % 16] + random.integers(-40, 40, (4000, 8))).astype(np.int64)
    centroids = middles + random.integers(-20, 20, (16, 8))
    ball = exponion.Ball(centroids)
    start = exponion.assign(block, np.zeros(4000, np.int64), np.full(4000, np.inf), np.zeros(4000), ball)
    full = np.array([exponion.squared(block, c) for c in centroids])
    assert (start[0] == full.argmin(0)).all()
    moved = centroids + random.integers(-5, 5, centroids.shape)
    step = np.sqrt(((moved - centroids) ** 2).sum(1))
    again = exponion.assign(block, start[0], (start[1] + step[start[0]]) * (1 + exponion.SLACK), np.maximum(start[2] - step.max(), 0), exponion.Ball(moved))
    assert (again[0] == np.array([exponion.squared(block, c) for c in moved]).argmin(0)).all()
    assert again[3].mean() < 4
