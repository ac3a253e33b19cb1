"""Equality of two stores by fingerprints: what differs is found by descending into the ranges of keys that differ.

A row's fingerprint is two 64-bit hashes of all compared columns. The sum of the fingerprints of a range of key hashes, in four parts that
cannot overflow, does not depend on the order of rows and counts repeats; equal sums of equal counts say that the range is equal. Sums are made
with map-side combining, 4,096 ranges a level; only the rows of ranges that differ at the last level are shuffled and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.plans.scratch import Scratch

BITS = 12
PARTS = ["n", "a", "b", "c", "d"]


def _hash(seed: int, columns: list[str]) -> Column:
    """Nulls count: hashing alone passes over them."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def _prepared(frame: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return frame.select(F.col(key).alias("key"), _hash(1, [key]).alias("k"), _hash(2, columns).alias("f"), _hash(3, columns).alias("g"))


def _range(level: int) -> Column:
    return F.shiftrightunsigned("k", 64 - BITS * level)


def _sums(rows: DataFrame, level: int) -> DataFrame:
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    parts = [low("f"), F.shiftrightunsigned("f", 32), low("g"), F.shiftrightunsigned("g", 32)]
    return rows.groupBy(_range(level).alias("range")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(p).alias(name) for p, name in zip(parts, "abcd", strict=True)])


def _differing(one: DataFrame, two: DataFrame, level: int) -> DataFrame:
    both = _sums(one, level).alias("x").join(_sums(two, level).alias("y"), "range", "full_outer")
    same = F.lit(True)
    for c in PARTS:
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    return both.where(~same).select("range")


def suspects(one: DataFrame, two: DataFrame, key: str, columns: list[str] | None = None, levels: int = 2) -> tuple[DataFrame, DataFrame]:
    """The rows of either store that lie in ranges that differ: key, f, g. columns: those compared, all common ones if not said."""
    columns = columns or [c for c in one.columns if c in two.columns and c != key]
    scratch = Scratch(one.sparkSession, "audit")
    rows = [_prepared(x, key, columns) for x in (one, two)]
    for level in range(1, levels + 1):
        found = scratch.write(_differing(*rows, level), f"ranges-{level}")
        # At most 4,096 ranges at the first level; later ones are joined as a table.
        rows = [r.join(F.broadcast(found) if level == 1 else found, _range(level) == F.col("range"), "left_semi") for r in rows]
    return rows[0].select("key", "f", "g"), rows[1].select("key", "f", "g")


def differences(one: DataFrame, two: DataFrame, key: str, columns: list[str] | None = None, levels: int = 2) -> DataFrame:
    """key, kind, n_one, n_two of each key whose rows differ: missing (in the first only), added, repeated (the same rows, other numbers of
    them) or changed. Null keys are one key."""
    a, b = suspects(one, two, key, columns, levels)
    rows = a.select("*", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select("*", F.lit(0).alias("x"), F.lit(1).alias("y")))
    each = rows.groupBy("key", "f", "g").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    keys = each.groupBy("key").agg(F.sum("x").alias("n_one"), F.sum("y").alias("n_two"), F.count_if(F.col("x") != F.col("y")).alias("other"), F.count_if((F.col("x") == 0) | (F.col("y") == 0)).alias("alone"))
    kind = F.when(F.col("n_two") == 0, "missing").when(F.col("n_one") == 0, "added").when(F.col("alone") == 0, "repeated").otherwise("changed")
    return keys.where("other > 0").select("key", kind.alias("kind"), "n_one", "n_two")


def require_equal(one: DataFrame, two: DataFrame, key: str, columns: list[str] | None = None) -> None:
    """An error that names some of the keys that differ."""
    found = differences(one, two, key, columns).orderBy("key").limit(5).collect()
    if found:
        raise ValueError(f"the stores differ: {[(r['key'], r['kind']) for r in found]}")


def alignment(queries: DataFrame, gold: DataFrame, key: str = "query_id") -> DataFrame:
    """key, why: ids that do not stand once on either side (no_gold, no_query, repeated)."""
    side = lambda f, name: f.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    both = side(queries, "q").join(side(gold, "g").withColumnRenamed(key, "other"), F.col(key).eqNullSafe(F.col("other")), "full_outer")
    why = F.when(F.col("g").isNull(), "no_gold").when(F.col("q").isNull(), "no_query").when((F.col("q") > 1) | (F.col("g") > 1), "repeated")
    return both.select(F.coalesce(F.col(key), F.col("other")).alias(key), why.alias("why")).where("why is not null")


def require_aligned(queries: DataFrame, gold: DataFrame, key: str = "query_id") -> None:
    found = alignment(queries, gold, key).orderBy(key).limit(5).collect()
    if found:
        raise ValueError(f"queries and gold are not aligned: {[tuple(r) for r in found]}")
