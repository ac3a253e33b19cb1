"""The bootstrap with draws made once, the generator's jumps, and quantiles found by counting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.functions import twister
from caselens.operators import metrics


@pytest.mark.parametrize("n", [0, 1, 311, 312, 623, 1000, 54_321])
def test_a_jump_lands_where_drawing_leads(n):
    plain = random.Random(42)
    for _ in range(n):
        plain.random()
    assert [plain.random() for _ in range(1500)] == twister.drawn_from(42, n).random_sample(1500).tolist()


def test_jumps_add_up():
    state = np.array(random.Random(7).getstate()[1][:-1], np.uint32)
    far = twister.jumped(twister.jumped(state, 10**15), 12_345)
    assert (far[1:] == twister.jumped(state, 10**15 + 12_345)[1:]).all()  # of the first word one bit counts
    assert (far[0] & twister.UPPER) == (twister.jumped(state, 10**15 + 12_345)[0] & twister.UPPER)


@pytest.mark.parametrize("options", [{}, {"piece": 700}, {"most": 0, "piece": 900, "block": 16}, {"most": 40, "piece": 1500, "block": 8}])
def test_interval_of_plain_draws(spark, options):
    pairs = [(("a", "b", None)[(i % 7) // 3], 97 * i % 211, i % 7 / 3, i % 5 / 4) for i in range(200)]
    frame = spark.createDataFrame(pairs, "g string, query_no long, one double, two double").repartition(5)
    got = {r.g: [r.delta, r.ci_low, r.ci_high] for r in metrics.bootstrap_frame(frame, "g", resamples=200, **options).collect()}
    assert len(got) == 3
    for g, values in got.items():
        want = metrics.bootstrap([two - one for name, _, one, two in sorted(pairs, key=lambda p: p[1]) if name == g], resamples=200)
        assert values == pytest.approx([want["delta"], *want["ci"]], abs=1e-12)


def test_all_rows_as_one_group(spark):
    pairs = [(i, i % 3 / 2, i % 4 / 3) for i in range(50)]
    r = metrics.bootstrap_frame(spark.createDataFrame(pairs, "query_no long, one double, two double"), resamples=100).first()
    want = metrics.bootstrap([two - one for _, one, two in pairs], resamples=100)
    assert [r.delta, r.ci_low, r.ci_high] == pytest.approx([want["delta"], *want["ci"]], abs=1e-12)
    none = metrics.bootstrap_frame(spark.createDataFrame([], "query_no long, one double, two double")).collect()
    assert [tuple(r) for r in none] == [(None, None, None)]  # as bootstrap([]) says


SHARES = [0.01, 0.07, 0.5, 0.95, 1.0]


@pytest.mark.parametrize("case", ["even", "skewed", "ties", "wide", "integers", "odd"])
def test_ranks_by_counting(spark, case):
    rng = random.Random(3)
    values = {
        "even": [rng.random() for _ in range(3000)], "skewed": [math.exp(rng.gauss(0, 12)) for _ in range(3000)], "ties": [float(rng.choice([1, 1, 1, 2, 9])) for _ in range(2000)],
        "wide": [-1.7e308, 1.7e308, 5e-324, 0.0, -0.0, 1e-300, 1.0, 3.0, 1e307] * 30, "integers": [2**60 + rng.randrange(3000) for _ in range(2000)], "odd": [1.0, None, float("nan"), float("nan"), -2.0, 7.0],
    }[case]
    kind = "long" if case == "integers" else "double"
    frame = spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(4)
    got = {r.share: r.value for r in metrics.ranked_quantiles(frame, "v", SHARES, most=16).collect()}
    order = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
    for share, value in got.items():
        want = order[max(1, math.ceil(round(share * len(order), 9))) - 1]
        assert value == want or (value != value and want != want), (case, share)


def test_one_value_and_none(spark):
    one = spark.createDataFrame([(4.5,)] * 300, "v double")
    assert metrics.ranked_quantiles(one, "v", [0.95], most=8).first().value == 4.5
    assert metrics.ranked_quantiles(one.where("v is null"), "v", [0.95]).first().value is None
    assert metrics.p95(one.withColumn("v", F.col("v") * 2), "v").first().p95 == 9.0
