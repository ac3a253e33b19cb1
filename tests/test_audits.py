"""Registers against their definition, store audits against sets, alignment of queries and gold."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caselens import catalog
from caselens.operators import audit, sketches


def brute(values):
    """(registers, estimate) by the definition, one value after the other."""
    registers = [0] * 4096
    for v in values:
        if v is not None:
            h = int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "big")
            bits = format(h >> 12, "052b")
            registers[h % 4096] = max(registers[h % 4096], bits.index("1") + 1 if "1" in bits else 53)
    raw = 0.7213 / (1 + 1.079 / 4096) * 4096 * 4096 / sum(2.0**-r for r in registers)
    zeros = registers.count(0)
    return registers, round(4096 * math.log(4096 / zeros) if raw <= 2.5 * 4096 and zeros else raw)


@pytest.mark.parametrize("n", [0, 1, 700, 9000, 60_000])
def test_registers_and_estimate(spark, n):
    values = [f"value {i * 7919 % max(n, 1)}" for i in range(n)] + [None, None]
    frame = spark.createDataFrame([(v,) for v in values], "v string").repartition(3)
    state = sketches.registers(frame, {"v": F.col("v")})
    want, estimate = brute(values)
    assert {(r.register, r["rank"]) for r in state.collect()} == {(i, r) for i, r in enumerate(want) if r}
    assert sketches.estimates(state, ["v"]).first().distinct_values == estimate
    assert abs(estimate - n) <= 0.05 * n + 1


def test_merged_batches_equal_one_pass(spark, tmp_path):
    frame = spark.range(5000).select((F.col("id") % 3000).cast("string").alias("a"), (F.col("id") % 7).cast("string").alias("b"))
    fields = {"a": F.col("a"), "b": F.col("b")}
    for i in range(3):
        sketches.registers(frame.where(f"a % 3 = {i}"), fields).write.parquet(f"{tmp_path}/{i}")
    stored = [spark.read.parquet(f"{tmp_path}/{i}") for i in (2, 0, 1, 0)]  # any order, one twice
    assert sorted(map(tuple, sketches.merged(*stored).collect())) == sorted(map(tuple, sketches.registers(frame, fields).collect()))


def test_query_of_sketches(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").toPandas()
    got = {r.field: (r.distinct_values, r.registers) for r in catalog.QUERIES["sketch_estimates"](spark, sf).collect()}
    for c in ("event_id", "user_id", "event_type", "props"):
        registers, estimate = brute([None if v is None else str(v) for v in events[c].tolist()])
        assert got[c] == (estimate, sum(map(bool, registers)))


COLUMNS = "k long, a string, b double"


def sides():
    rng = random.Random(5)
    one = [(i, rng.choice(["x", "y", None]), rng.choice([1.0, None, -0.5])) for i in range(3000)] + [(None, "n", 1.0), (9, "again", 2.0)]
    two = [r for r in one if r[0] not in (5, 77, 1234)]
    two += [(17, *next(r for r in two if r[0] == 17)[1:]), (-1, "new", 0.0), (None, "n", 1.0)]
    two = [(40, "other", 1.0) if r[0] == 40 else (41, r[2] and "x", None) if r[0] == 41 else r for r in two]
    rng.shuffle(two)
    return one, two


def test_differences_are_those_of_the_multisets(spark):
    one, two = sides()
    got = {r.key: (r.kind, r.n_one, r.n_two) for r in audit.differences(spark.createDataFrame(one, COLUMNS).repartition(3), spark.createDataFrame(two, COLUMNS), "k").collect()}
    want = {}
    for k in {r[0] for r in one + two}:
        a, b = Counter(r for r in one if r[0] == k), Counter(r for r in two if r[0] == k)
        if a != b:
            want[k] = ("missing" if not b else "added" if not a else "repeated" if a.keys() == b.keys() else "changed", sum(a.values()), sum(b.values()))
    assert got == want and {"missing", "added", "repeated", "changed"} == {v[0] for v in got.values()}


def test_equal_ranges_are_not_compared(spark):
    one, two = sides()
    rows = audit.suspects(spark.createDataFrame(one, COLUMNS), spark.createDataFrame(two, COLUMNS), "k")
    assert sum(r.count() for r in rows) < 40
    same = spark.createDataFrame(one, COLUMNS)
    assert [r.count() for r in audit.suspects(same, same.repartition(5), "k")] == [0, 0]
    audit.require_equal(same, same.orderBy(F.rand(3)), "k")
    with pytest.raises(ValueError, match="missing"):
        audit.require_equal(same, same.where("k <> 3"), "k")


def test_nulls_are_values(spark):
    one, two = spark.createDataFrame([(1, None, "v")], "k int, a string, b string"), spark.createDataFrame([(1, "v", None)], "k int, a string, b string")
    assert audit.differences(one, two, "k").first().kind == "changed"


def test_alignment(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "query_id long")
    assert sorted(map(tuple, audit.alignment(ids(1, 2, 3, 3), ids(2, 3, 4)).collect())) == [(1, "no_gold"), (3, "repeated"), (4, "no_query")]
    audit.require_aligned(ids(1, 2), ids(2, 1))
    with pytest.raises(ValueError, match="no_query"):
        audit.require_aligned(ids(1), ids(1, 2))
