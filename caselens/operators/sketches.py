"""Distinct counts from registers that are stored and merged: 4,096 of them for each field, filled by a stated hash.

A value's hash is blake2b of 8 bytes, big-endian. Its low 12 bits choose a register; the rank is the place of the first one in the other 52
bits, from the highest, 53 if there is none. A register keeps the largest rank. States of batches merge by the same maximum, in any order, so
merged batches equal one pass; a state has a row for each register that was touched, so at most 4,096 a field."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the registers.
BITS = 12
SIZE = 1 << BITS
REST = 64 - BITS

STATE = "field string, register int, rank int"


def _ranks(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rest = hashes >> np.uint64(BITS)
    # The length of 52 bits fits a double exactly.
    length = np.frexp(rest.astype(np.float64))[1]
    return (hashes & np.uint64(SIZE - 1)).astype(np.int64), np.where(rest > 0, REST - length + 1, REST + 1)


def _filled(names: list[str]):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        state = np.zeros((len(names), SIZE), np.int32)
        for batch in batches:
            for i in range(len(names)):
                distinct = pc.drop_null(pc.unique(batch.column(i))).to_pylist()
                hashes = np.array([int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "big") for v in distinct], np.uint64)
                if len(hashes):
                    register, rank = _ranks(hashes)
                    np.maximum.at(state[i], register, rank)
        field, register = np.nonzero(state)
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in field], pa.string()), pa.array(register.astype(np.int32)), pa.array(state[field, register])], ["field", "register", "rank"])

    return run


def registers(frame: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """field, register, rank of the strings of each field; nulls are no values. A task sends 4,096 rows a field at most."""
    names = list(fields)
    slim = frame.select(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(fields.values())])
    return merged(slim.mapInArrow(_filled(names), STATE))


def merged(*states: DataFrame) -> DataFrame:
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    return every.groupBy("field", "register").agg(F.max("rank").alias("rank"))


def estimates(state: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """field, distinct_values, registers (those touched). fields: also named ones without any value."""
    sums = state.groupBy("field").agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count(F.lit(1)).alias("registers"))
    if fields is not None:
        every = state.sparkSession.createDataFrame([(f,) for f in fields], "field string")
        sums = every.join(sums, "field", "left").select("field", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("registers", F.lit(0).cast("long")).alias("registers"))
    zeros = SIZE - F.col("registers")
    raw = F.lit(0.7213 / (1 + 1.079 / SIZE) * SIZE * SIZE) / (F.col("s") + zeros)
    linear = SIZE * F.log(F.lit(float(SIZE)) / zeros)
    value = F.when((raw <= 2.5 * SIZE) & (zeros > 0), linear).otherwise(raw)
    return sums.select("field", F.bround(value).cast("long").alias("distinct_values"), "registers")
