"""Vector search around pivots: the same rows as a full scan, from fewer pairs where vectors lie in groups."""

import numpy as np
import pytest

from caselens.operators import dense


def clustered(n, middles, dims=12, seed=3, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(size=(middles, dims))
    x = centres[np.arange(n) % middles] + spread * rng.normal(size=(n, dims))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame_of(spark, vectors, name="vec_id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], f"{name} long, embedding array<float>").repartition(4)


def full(queries, vectors, k, score):
    out = {}
    for i, q in enumerate(queries.astype(np.float64)):
        s = np.round(score(q, vectors.astype(np.float64)), 9)
        out[i] = np.lexsort((np.arange(len(s)), -s))[:k].tolist()
    return out


def ranked(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.docid)
    return out


DOT = lambda q, v: v @ q
NEAR = lambda q, v: -np.abs(v - q).sum(1)


@pytest.fixture(params=[0, dense.FEW])
def few(request, monkeypatch):
    """Around pivots, and all pairs as for few vectors."""
    monkeypatch.setattr(dense, "FEW", request.param)


@pytest.mark.parametrize("kind", ["groups", "spread", "equal", "norms"])
def test_same_rows_as_a_full_scan(spark, few, kind):
    rng = np.random.default_rng(1)
    if kind == "groups":
        vectors = clustered(900, 30)
    elif kind == "spread":
        vectors = rng.normal(size=(300, 16)).astype(np.float32)
    elif kind == "equal":  # one vector holds a third of all rows: ties go to the smaller id
        vectors = clustered(300, 10)
        vectors[::3] = vectors[0]
    else:
        vectors = (clustered(300, 10) * rng.uniform(0.1, 9, (300, 1))).astype(np.float32)
    queries = vectors[:40]
    q, v = frame_of(spark, queries, "query_id"), frame_of(spark, vectors)
    assert ranked(dense.inner_product_topk(q, v, 7, block=32)) == full(queries, vectors, 7, DOT)
    assert ranked(dense.l1_topk(q, v, 7, block=32)) == full(queries, vectors, 7, NEAR)


def test_more_places_than_vectors_and_values_that_are_no_numbers(spark, few):
    vectors = clustered(20, 4)
    vectors[5] = np.nan
    v = frame_of(spark, vectors)
    got = ranked(dense.inner_product_topk(frame_of(spark, vectors[:5], "query_id"), v, 50, block=8))
    assert all(sorted(x) == list(range(20)) and x[-1] == 5 for x in got.values())
    assert ranked(dense.inner_product_topk(v.limit(0), v, 3)) == ranked(dense.inner_product_topk(v, v.limit(0), 3)) == {}


def test_pairs_grow_more_slowly_than_all_pairs(spark):
    """Twice the vectors in twice the groups, all of them queries: four times the pairs, but not four times the work."""
    done = []
    for n in (1000, 2000):
        v = frame_of(spark, clustered(n, n // 50, spread=0.01))
        r = dense.pairs_scored(v, v, 5, block=64).first()
        assert r.pairs == n * n
        done.append(r.scored)
    assert done[1] < 0.35 * 2000 * 2000 and done[1] < 3.2 * done[0]


def test_bounds_hold(spark):
    rng = np.random.default_rng(2)
    vectors, queries, pivot = rng.normal(size=(500, 8)), rng.normal(size=(50, 8)) * 3, rng.normal(size=(1, 8))
    for measure in (dense.INNER, dense.L1):
        gaps = measure.distance(vectors, pivot)[:, 0]
        ring = (gaps > np.quantile(gaps, 0.3)) & (gaps < np.quantile(gaps, 0.4))
        bound = measure.bound(measure.distance(queries, pivot)[:, 0], gaps[ring].min(), gaps[ring].max(), np.linalg.norm(vectors[ring], axis=1).max(), np.linalg.norm(queries, axis=1))
        assert (measure.score(queries, vectors[ring]).max(1) <= bound + 1e-9).all()
