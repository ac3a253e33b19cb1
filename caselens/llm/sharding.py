"""Sharding: global byte-size prefix sums from per-partition totals, cut at equal targets to give contiguous balanced shards.

Rows stand in order of (id, crc32, size), null ids first. Each range partition sums its own sizes in one pass; the driver adds
up one total per partition, never per row. A row goes to the shard that holds the middle of its bytes, so a shard differs from
the equal target by at most one row. Null texts have size `overhead` and crc 0; rows that repeat an id or a whole row stand side
by side; an empty table gives an empty result; a row larger than a shard leaves the shards it spans empty. A text counts with all its
bytes, however long. Extra columns are not read by `shard_by_bytes` and pass through `write_shards`.

The law is `bytes`, sizes near equal. It speaks of rows: equal texts are groups of the table, not of the result, and may fall into
different shards."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import Scratch, partitions_for, whole


def _running(batches):
    """Adds to each row of a sorted partition the bytes and rows before it in that partition."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, size_before, rows_before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        sizes = batch.column("size").to_numpy(zero_copy_only=False)
        ends = size_before + np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(sizes), part, np.int64)), pa.array(ends - sizes), pa.array(rows_before + np.arange(len(sizes)))],
            [*batch.schema.names, "part", "bytes_before", "rows_before"],
        )
        if len(sizes):
            size_before, rows_before = int(ends[-1]), rows_before + len(sizes)


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot, start (bytes of all rows before)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "shards")
    text = whole(F.col(text_col))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(text).alias("text_crc32"))
    keys = ["doc_id", "text_crc32", "size"]
    ordered = slim.repartitionByRange(partitions_for(docs), *keys).sortWithinPartitions(*keys)
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, size long, text_crc32 long, part long, bytes_before long, rows_before long"
    ranked = scratch.write(ordered.mapInArrow(_running, schema), "ranked")

    totals = sorted(tuple(r) for r in ranked.groupBy("part").agg(F.sum("size"), F.count(F.lit(1))).collect())
    starts = accumulate(((0, 0), *(t[1:] for t in totals)), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    offsets = [(t[0], *s) for t, s in zip(totals, starts, strict=False)]
    total = max(1, sum(t[1] for t in totals))
    offsets = spark.createDataFrame(offsets or [(0, 0, 0)], "part long, part_bytes long, part_rows long")
    placed = ranked.join(F.broadcast(offsets), "part").select(
        "doc_id", "size", "text_crc32", (F.col("part_bytes") + F.col("bytes_before")).alias("start"), (F.col("part_rows") + F.col("rows_before")).alias("row")
    )
    placed = placed.withColumn("shard", F.expr(f"cast(least({n_shards - 1}L, ((2 * start + size) * {n_shards}L) div {2 * total}L) as int)"))
    firsts = dict(tuple(r) for r in placed.groupBy("shard").agg(F.min("row")).collect())
    first = F.array(*[F.lit(firsts.get(s, 0)).cast("long") for s in range(n_shards)])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.element_at(first, F.col("shard") + 1)).alias("slot"), "start")


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes docs as Parquet folders shard=0, shard=1, ... in shard order; for tables whose ids are unique."""
    placed = shard_by_bytes(docs, n_shards, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("shard").alias("shard"), F.col("slot").alias("__slot"))
    joined = docs.join(placed, F.col(id_col).eqNullSafe(F.col("__id"))).drop("__id")
    joined.repartitionByRange(n_shards, "shard", "__slot").sortWithinPartitions("shard", "__slot").drop("__slot").write.partitionBy("shard").parquet(path)
