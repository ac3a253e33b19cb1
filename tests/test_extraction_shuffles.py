"""A run of extraction shuffles the texts once, and nothing that it keeps holds them."""

import random

import pytest
from pyspark.sql import functions as F

from caselens.operators import extraction
from caselens.queries import workflow


def _shuffled(spark) -> int:
    """Bytes that the stages of the session have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    """Sixty texts of random signs, which no codec makes much smaller; every sixth is a copy of the one before."""
    draw, rows = random.Random(4), []
    for i in range(60):
        rows.append((str(i), i, rows[-1][2] if i % 6 == 5 else f"one{i} two{i} " + "".join(map(chr, draw.choices(range(33, 127), k=40_000)))))
    path = str(tmp_path_factory.mktemp("records") / "r")
    spark.createDataFrame(rows, "source_id string, source_row long, case_content string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_are_shuffled_once(spark, records, no_broadcast, tmp_path):
    size, contract = 60 * 40_000, extraction.Contract("m", segment_chars=1 << 30)
    run = lambda **o: extraction.run_extraction(records, extraction.LeadingWords, contract, partitions=2, sleep=lambda s: None, **o).drop("case_content")
    before = _shuffled(spark)
    run().write.parquet(str(tmp_path / "first"))
    once = _shuffled(spark) - before
    assert 0.5 * size < once < 1.2 * size
    first = spark.read.parquet(str(tmp_path / "first"))
    extraction.cache_rows(first.where("source_row % 3 = 1")).write.parquet(str(tmp_path / "cache"))
    before = _shuffled(spark)
    run(cache=spark.read.parquet(str(tmp_path / "cache")), done=first.where("source_row % 3 = 0")).write.parquet(str(tmp_path / "again"))
    assert _shuffled(spark) - before < 1.2 * size
    again = {r.source_row: r for r in spark.read.parquet(str(tmp_path / "again")).collect()}
    # 5, 11, ... are copies of 4, 10, ..., which are in the cache.
    assert {k: r.attempts for k, r in again.items()} == {i: int(i % 3 == 2 and i % 6 != 5) for i in range(60) if i % 3}
    for r in first.where("source_row % 3 > 0").collect():
        assert r.events and r.views and r.counts and all(again[r.source_row][c] == r[c] for c in r.__fields__ if c != "attempts")


def test_results_hold_no_texts(spark, sf):
    kept = workflow._extracted(spark, sf)
    assert "case_content" not in kept.columns and kept.count() == workflow.documents(spark, sf).count()


@pytest.mark.parametrize("partitions", [3, None])
def test_calls_run_in_few_tasks(spark, records, tmp_path, partitions):
    """However many partitions the texts are shuffled to, `partitions` tasks call the model, each text once; without it all of them do."""
    folder = str(tmp_path)

    class Noting(extraction.LeadingWords):
        def propose(self, text, limits=None):
            import uuid

            from pyspark import TaskContext

            with open(f"{folder}/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}", "w"):
                pass
            return super().propose(text)

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        out = extraction.run_extraction(records, Noting, extraction.Contract("m", segment_chars=1 << 30), partitions=partitions, sleep=lambda s: None)
        assert out.where(F.col("case_content").isNotNull()).count() == 60
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    calls = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(calls) == 50 and (8 < len(set(calls)) <= 12 if partitions is None else len(set(calls)) <= 3)


def test_tasks_of_queries_are_not_bounded_in_number(spark, sf, monkeypatch):
    seen, real = [], extraction.run_extraction
    monkeypatch.setattr(extraction, "run_extraction", lambda *a, **o: seen.append(o["partitions"]) or real(*a, **o))
    for name in ("extraction_resumed", "extraction_segments"):
        workflow.QUERIES[name](spark, sf)
    assert seen == [None] * 3
