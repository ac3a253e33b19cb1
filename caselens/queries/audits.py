"""Queries of sketches, store audits and alignment, each with its SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens.operators import audit, sketches
from caselens.plans.scratch import Scratch
from caselens.queries.retrieval import benchmark, documents, gold, table
from caselens.streaming.incremental import append_windows


def _other_store(docs):
    """The documents as a second store: some gone, some changed, some twice, some new."""
    key = F.col("doc_id")
    kept = docs.where(key % 97 != 0).withColumn("lang", F.when(key % 89 == 0, F.concat("lang", F.lit("x"))).otherwise(F.col("lang")))
    return kept.unionByName(kept.where(key % 83 == 0)).unionByName(docs.where(key % 79 == 0).withColumn("doc_id", -key - 1))


def store_differences(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = audit.differences(docs, _other_store(docs), "doc_id", ["text", "lang", "source", "n_chars"])
    return found.withColumnRenamed("key", "doc_id")


def query_alignment(spark, sf_dir):
    """Queries of the benchmark and gold of which every third is gone, every seventh twice, and one more is there for every fifth."""
    have = gold(spark, sf_dir).select("query_id")
    held = have.where("query_id % 3 <> 0")
    held = held.unionByName(held.where("query_id % 7 = 0")).unionByName(have.where("query_id % 5 = 0").select((-F.col("query_id") - 1).alias("query_id")))
    return audit.alignment(benchmark(spark, sf_dir), held)


def sketch_estimates(spark, sf_dir):
    """Distinct values of the events' columns, from the stored registers of four batches."""
    scratch, events = Scratch(spark, "registers"), table(spark, sf_dir, "events")
    fields = {c: F.col(c) for c in ("event_id", "user_id", "event_type", "props")}
    states = [scratch.write(sketches.registers(events.where(f"event_id % 4 = {i}"), fields), f"batch-{i}") for i in range(4)]
    return sketches.estimates(sketches.merged(*states))


def stream_windows(spark, sf_dir):
    """Hourly counts of events that come in four parts of their time: each part is a run of its own that goes on from the state of the last."""
    scratch = Scratch(spark, "windows")
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    low, high = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.least(F.lit(3), F.floor((F.unix_micros("ts") - (low or 0)) * 4 / ((high or 0) - (low or 0) + 1)))
    for i in range(4):
        events.where(part == i).write.mode("append").parquet(scratch.path("in"))
        append_windows(spark, scratch.path("in"), events.schema, scratch.path("state"), scratch.path("out"))
    closed = spark.read.schema("start timestamp, end timestamp, event_type string, n long, value double").parquet(scratch.path("out"))
    return closed.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("value", 6).alias("value"))


QUERIES = {f.__name__: f for f in (store_differences, query_alignment, sketch_estimates, stream_windows)}

SQL = {
    "stream_windows": """
        SELECT strftime(start, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 6) AS value FROM (SELECT date_trunc('hour', ts) AS start, event_type, value FROM events)
        GROUP BY start, event_type HAVING start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    "store_differences": """
        SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN 'missing' WHEN doc_id % 89 = 0 AND lang IS NOT NULL THEN 'changed' ELSE 'repeated' END AS kind,
               1::BIGINT AS n_one, CASE WHEN doc_id % 97 = 0 THEN 0 WHEN doc_id % 83 = 0 THEN 2 ELSE 1 END::BIGINT AS n_two
        FROM documents WHERE doc_id % 97 = 0 OR (doc_id % 89 = 0 AND lang IS NOT NULL) OR doc_id % 83 = 0
        UNION ALL SELECT -doc_id - 1, 'added', 0, 1 FROM documents WHERE doc_id % 79 = 0""",
    "query_alignment": """
        SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'no_gold' ELSE 'repeated' END AS why FROM benchmark WHERE item_id % 3 = 0 OR item_id % 7 = 0
        UNION ALL SELECT -item_id - 1, 'no_query' FROM benchmark WHERE item_id % 5 = 0""",
}
