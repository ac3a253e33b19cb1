"""Incremental builds: files that arrive are taken up once, in micro-batches, and what is done is never done again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from caselens.operators.dense import Encoder, encode_frame


def drain(spark: SparkSession, source: str, schema, checkpoint: str, take: Callable[[DataFrame, int], None], files_per_batch: int = 16) -> None:
    """Runs `take` on everything that has come since the last call, a bounded number of files at a time; a batch that was
    interrupted runs again under its number."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def encode_new(spark: SparkSession, source: str, schema, checkpoint: str, out: str, encoder: Encoder, id_col: str = "docid", text_col: str = "text") -> None:
    """Vector shards of new documents, a folder for each batch: a repeated batch overwrites its own shard and no other."""

    def take(batch: DataFrame, number: int) -> None:
        rows = encode_frame(batch.select(id_col, text_col), encoder, text_col).select(F.col(id_col).alias("docid"), "embedding")
        rows.sortWithinPartitions("docid").write.mode("overwrite").parquet(f"{out}/shard={number}")

    drain(spark, source, schema, checkpoint, take)


def event_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by window and type, for batch and stream alike; a stream forgets windows older than `late`."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def append_windows(spark: SparkSession, source: str, schema, checkpoint: str, out: str, every: str = "1 hour", late: str = "10 minutes", files_per_batch: int = 16) -> dict[str, int]:
    """Appends the windows of event_counts that are closed to a table, from the files that have come since the last call; open windows stay in
    the checkpoint, which a later call, in another session too, goes on from. Returns how many rows it read, how many counts came too late
    for their window (one for each task, window and type; they enter no other window) and how many windows are still open."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    flat = event_counts(stream, every, late).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "value")
    run = flat.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    steps = run.recentProgress
    states = [o for p in steps for o in p["stateOperators"]]
    return {"rows": sum(p["numInputRows"] for p in steps), "late": sum(o["numRowsDroppedByWatermark"] for o in states), "open": states[-1]["numRowsTotal"] if states else 0}


def counted(frame: DataFrame, name: str, **counters) -> tuple[DataFrame, Observation]:
    """frame, and the counts of its rows that are there once an action has run over it; counters: further aggregates by name."""
    seen = Observation(name)
    return frame.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counters.items()]), seen


def resumed(todo: DataFrame, done: DataFrame, key: str, content: str, failed: DataFrame | None = None) -> DataFrame:
    """Rows that are not done; an error where a done row has other content now, or is among the failed ones too."""
    if failed is not None and not done.join(failed.select(key), key, "left_semi").isEmpty():
        raise ValueError("a record is done and failed")
    both = todo.join(done.select(key, F.col(content).alias("__was")), key)
    if not both.where(F.col(content) != F.col("__was")).isEmpty():
        raise ValueError("a record that is done has changed")
    return todo.join(done.select(key).distinct(), key, "left_anti")
