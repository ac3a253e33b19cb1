import json
import os

import pytest
from pyspark.sql import functions as F

from caselens.operators import dense, profile
from caselens.sources import files
from caselens.streaming import incremental


@pytest.fixture(scope="module")
def tickets(spark):
    rows = [
        ("1", "o1", "积水 13800138000\t表", "积水", "是", "2025-01-01 10:00:00", "2025-01-01 10:00:05", '[{"type":1,"value":"a","label":"A"}]', "一", None, "三"),
        ("2", "o1", "漏水", "漏水", "6015", "bad", "2025-01-02 00:00:00", "null", "一", "二", None),
        ("3", "o2", None, "x", "否", "2025-01-03 10:00:00", "2025-01-03 09:00:00", "{bad", None, None, None),
    ]
    return spark.createDataFrame(rows, "id string, order_id string, case_content string, case_goal string, case_is_visit string, call_time string, case_complete_time string, knowledge_quote string, t1 string, t2 string, t3 string")


def test_profile(tickets):
    groups = profile.group_variation(tickets, "order_id", {"content": ["case_content"], "goal": ["case_goal"]})
    s = profile.group_summary(groups).first()
    assert (s.groups, s.rows, s.multirow_groups, s.rows_in_multirow_groups, s.content_variation) == (2, 3, 1, 2, 1)
    v = profile.violations(tickets, {"case_is_visit": profile.DOMAIN_RULES["case_is_visit"]})
    assert v.where("any_violation").count() == 1
    p = {r.field: r for r in profile.pii_counts(tickets, ["case_content", "case_goal"]).collect()}
    assert (p["case_content"].mobile_rows, p["case_content"].pii_rows, p["case_goal"].pii_rows) == (1, 1, 0)
    assert {r.relation for r in tickets.select(profile.text_relation(F.col("case_content"), F.col("case_goal")).alias("relation")).collect()} == {"goal_contained_in_content", "exactly_equal", "content_missing_only"}
    h = profile.hierarchy(tickets, ["t1", "t2", "t3"]).select("depth", "gap", "path").collect()
    assert [tuple(r) for r in h] == [(3, True, "一 > <MISSING> > 三"), (2, False, "一 > 二"), (0, False, None)]
    d = {r.bucket: r["count"] for r in profile.duration_histogram(tickets.where("id <> '2'"), "call_time", "case_complete_time").collect()}
    assert d == {4: 1, -1: 1}
    i = profile.json_items(tickets, "knowledge_quote").first()
    assert (i.missing, i.invalid_json, i.valid_json, i["items"], i.items_missing_label) == (1, 1, 1, 1, 0)
    c = {r.field: r for r in profile.column_profile(tickets, ["case_content", "case_is_visit"]).collect()}
    assert (c["case_content"].filled, c["case_content"].blank, c["case_is_visit"].integer_like) == (2, 1, 1)
    assert all("138" not in str(r) for r in profile.top_values(tickets, "case_content").collect())
    n = {r.field: r for r in profile.distinct_counts(tickets, ["case_is_visit"], ["case_content"]).collect()}
    assert (n["case_is_visit"].distinct_values, n["case_content"].distinct_values, n["<row>"].distinct_values) == (3, 2, 3)


def test_tsv_with_quotes_and_marks(spark, tmp_path):
    path = f"{tmp_path}/a.tsv"
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        f.write('id\tcase_content\n1\t"line\none"\n2\t"tab\there ""q"""\n3\tnull\n')
    rows = files.load_records(spark, path).orderBy("source_row").collect()
    assert [(r.source_id, r.case_content, r.source_row) for r in rows] == [("1", "line\none", 1), ("2", 'tab\there "q"', 2), ("3", "", 3)]
    assert {r.width: r.records for r in files.record_widths(spark, path).collect()} == {2: 4}
    assert files.file_hashes(spark, path).first().sha256 == files.file_sha256(path)
    with pytest.raises(ValueError):
        files.read_tsv(spark, path, {"missing"})
    with open(path, "a") as f:
        f.write("4\ta\tb\n")
    assert files.read_tsv(spark, path, strict=False).cache().where(f"{files.CORRUPT} is not null").count() == 1
    with pytest.raises(Exception):  # noqa: B017  Spark's own error
        files.read_tsv(spark, path).count()


def test_json_lines_and_reports(spark, tmp_path):
    path = f"{tmp_path}/a.jsonl"
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps({"source_id": "1", "case_content": "a b"}, ensure_ascii=False) + "\n\n" + json.dumps({"source_id": "2", "case_content": "c", "source_row": 9}) + "\n")
    assert [(r.source_id, r.case_content, r.source_row) for r in files.load_records(spark, path).orderBy("source_id").collect()] == [("1", "a b", 1), ("2", "c", 9)]
    files.write_report(f"{tmp_path}/r/x.json", files.to_json({"a": "é"}))
    assert oct(os.stat(f"{tmp_path}/r/x.json").st_mode)[-3:] == "600"
    with pytest.raises(FileExistsError):
        files.write_report(f"{tmp_path}/r/x.json", "")
    files.write_manifest(f"{tmp_path}/m", "v1", sha="a")
    assert files.read_manifest(f"{tmp_path}/m", "v1", sha="a")["sha"] == "a"
    with pytest.raises(ValueError):
        files.read_manifest(f"{tmp_path}/m", "v2")
    with pytest.raises(ValueError):
        files.to_json({"a": float("nan")})
    with files.exclusive(f"{tmp_path}/lock"), pytest.raises(FileExistsError), files.exclusive(f"{tmp_path}/lock"):
        pass
    page = files.annotation_page(spark.createDataFrame([("</script><b>",)], "t string"), "a<b")
    assert "</script><b>" not in page and "a&lt;b" in page
    assert files.markdown_table([{"a": "x|y", "b_rate": 0.5}], {"a": "A", "b_rate": "B"}).endswith("| x\\|y | 50.00% |\n")


def test_new_files_are_taken_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "docid long, text string")
    encoder, out = dense.HashEncoder(8), f"{tmp_path}/v"
    for n in range(2):
        docs.where(f"docid % 2 = {n}").write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):
            incremental.encode_new(spark, f"{tmp_path}/in", docs.schema, f"{tmp_path}/c", out, encoder)
        assert spark.read.parquet(out).count() == 5 * (n + 1)
    dense.validate_shards(spark.read.parquet(out), 8)
    with pytest.raises(ValueError):
        incremental.resumed(docs, docs.withColumn("text", F.lit("x")), "docid", "text")
    assert incremental.resumed(docs, docs.limit(3), "docid", "text").count() == 7
