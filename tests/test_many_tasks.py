"""Sheets and files of whole tables are not the work of one task."""

import pytest
from pyspark.sql import functions as F

from caselens.operators import annotation
from caselens.queries import workflow
from caselens.sources import files


def _single(frame) -> bool:
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return "SinglePartition" in plan or "TakeOrderedAndProject" in plan


def test_a_sheet_of_all_records_goes_through_no_single_task(spark):
    records = spark.range(100).select(F.col("id").cast("string").alias("source_id"), F.col("id").alias("source_row"), F.lit("text").alias("case_content"))
    sheet = annotation.gold_worksheet(records, 1 << 30)
    assert sheet.count() == 100 and not _single(sheet)


@pytest.mark.parametrize("limit", [1, 6, 37, 38, 299, 300, 400])
def test_large_limits_take_the_first_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(annotation, "ONE_TASK", 0)
    row = F.when(F.col("id") % 60 == 0, F.lit(None)).otherwise(F.floor(F.col("id") / 2) * 7)
    records = spark.range(300).repartition(5, "id").select(F.col("id").alias("source_id"), row.cast("long").alias("source_row"))
    got = annotation.first_rows(records, limit).select("source_row").collect()
    want = records.orderBy("source_row").limit(limit).select("source_row").collect()
    key = lambda r: -1 if r[0] is None else r[0]
    assert sorted(map(key, got)) == sorted(map(key, want))


def _parts(spark, path) -> int:
    return spark.read.format("binaryFile").load(f"{path}/part-*").where("length > 0").count()


def test_numbers_go_on_from_part_to_part(spark, tmp_path):
    rows = spark.range(1000).select((999 - F.col("id")).alias("k")).repartition(7)
    files.write_jsonl(rows.repartitionByRange(5, "k").sortWithinPartitions("k"), str(tmp_path / "a"))
    assert _parts(spark, tmp_path / "a") == 5
    got = files.read_jsonl(spark, str(tmp_path / "a"), "k long", parts=True).collect()
    assert len(got) == 1000 and all(r.source_row == r.k + 1 for r in got)
    apart = files.read_jsonl(spark, str(tmp_path / "a"), "k long").collect()
    assert sum(r.source_row == 1 for r in apart) == 5


def test_only_the_last_line_of_all_parts_may_be_torn(spark, tmp_path):
    lines = [f'{{"k": "{i}"}}' for i in range(20)]
    for name, torn in (("good", 19), ("bad", 9)):
        (tmp_path / name).mkdir()
        own = [line[:-2] if i == torn else line for i, line in enumerate(lines)]
        for i in (0, 1):
            (tmp_path / name / f"part-{i:05d}.txt").write_text("\n".join(own[10 * i : 10 * i + 10]))
    got = files.read_repaired_jsonl(spark, str(tmp_path / "good"), "k string", "k", parts=True).collect()
    assert sorted((int(r.k), r.source_row) for r in got) == [(i, i + 1) for i in range(19)]
    with pytest.raises(Exception, match="torn"):
        files.read_repaired_jsonl(spark, str(tmp_path / "bad"), "k string", "k", parts=True).collect()


@pytest.mark.parametrize("name", ["jsonl_round_trip", "repaired_jsonl"])
def test_files_of_whole_tables_are_written_by_many_tasks(spark, sf, monkeypatch, name):
    seen = []
    real = files.numbered
    monkeypatch.setattr(files, "numbered", lambda read, *a: seen.extend(read.inputFiles()) or real(read, *a))
    partitions = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        workflow.QUERIES[name](spark, sf)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", partitions)
    assert len(seen) > 1
