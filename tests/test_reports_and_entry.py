import io
import json

import numpy as np
import pytest

from caselens import __main__ as command
from caselens.operators import address, annotation, dense, extraction, lexical, profile
from caselens.plans import report
from caselens.sources import files


def test_profile_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x|y"), ("b", None), ("null", "13800138000")], "k string, v string")
    catalogue = spark.createDataFrame([("k", "Key", "what it is", "sure", "now", "online", "id", "true", "really?", "none")], "name string, " + ", ".join(f"{a} string" for a in report.ATTRIBUTES))
    got = report.write_profile(rows, ["k", "v"], ["k"], catalogue, f"{tmp_path}/t", tmp_path / "r", "Rows")
    assert [(c["name"], c["filled"], c["distinct"], c["distinct_method"]) for c in got["columns"]] == [("k", 2, 2, "exact"), ("v", 2, 2, "hll")]
    text = (tmp_path / "r" / "profile.md").read_text()
    assert "| k | 2 | 33.33% |" in text and "138" not in text
    assert "- `k`: really?" in (tmp_path / "r" / "data_dictionary.md").read_text()
    assert spark.read.option("header", True).csv(f"{tmp_path}/t/field_dictionary.csv").where("name = 'v'").first().business_name == "unmapped"
    assert json.loads((tmp_path / "r" / "profile.json").read_text())["rows"] == 3


def test_search_from_the_command_line(spark, tmp_path):
    texts = ["幸福小区3号楼门口积水", "幸福小区排水慢", "劳动东路3号积水"]
    cases = spark.createDataFrame([(i, f"old-{i}", i, t, "2025-08-01 10:00:00") for i, t in enumerate(texts, 1)], "docid long, source_id string, source_row long, content string, call_time string")
    cases.write.parquet(f"{tmp_path}/cases")
    lexical.build_index(cases, "docid", "content").write(f"{tmp_path}/index")
    address.write_address_index(address.build_address_index(cases), f"{tmp_path}/addresses")
    (tmp_path / "queries").write_text("积水\n\n排水\n", encoding="utf-8")

    def ask(*argv):
        out = io.StringIO()
        command.main([str(tmp_path), *argv], spark, out)
        return [json.loads(line) for line in out.getvalue().splitlines()]

    assert {r["source_id"] for r in ask("积水")[0]["results"]} == {"old-1", "old-3"}
    assert [r["query"] for r in ask("--file", str(tmp_path / "queries"))] == ["积水", "排水"]
    assert [r["source_id"] for r in ask("幸福小区3号楼", "--mode", "address")[0]["results"]] == ["old-1"]
    assert "error" in ask("积水", "--mode", "combined")[0]


class Narrow(dense.HashEncoder):
    max_chars = 3

    def encode(self, texts):
        if len(texts) > 2:
            raise MemoryError
        return super().encode(texts)


def test_batches_that_do_not_fit_are_halved(spark):
    encoder = Narrow(8)
    texts = [f"t{i}" for i in range(7)]
    assert np.array_equal(dense.encode_halving(encoder, texts), dense.HashEncoder(8).encode(texts))
    assert tuple(dense.truncated(spark.createDataFrame([("abcd",), ("ab",), (None,)], "text string"), encoder).first()) == (2, 1)


def test_torn_lines(spark, tmp_path):
    good, schema = '{"id": "1"}\n', "id string"
    (tmp_path / "a").write_text(good + '{"id": "2"')
    assert [(r.id, r.source_row) for r in files.read_repaired_jsonl(spark, f"{tmp_path}/a", schema, "id").collect()] == [("1", 1)]
    (tmp_path / "b").write_text('{"id"\n' + good)
    with pytest.raises(Exception, match="torn"):
        files.read_repaired_jsonl(spark, f"{tmp_path}/b", schema, "id").collect()
    (tmp_path / "c").write_text(good + good)
    with pytest.raises(ValueError):
        files.read_repaired_jsonl(spark, f"{tmp_path}/c", schema, "id")


def test_rows_are_numbered_over_splits(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(5000)))
    size, cost = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        read = spark.read.option("lineSep", "\n").text(str(tmp_path))
        assert read.rdd.getNumPartitions() > 10
        assert all(int(r.value[1:]) + 1 == r.source_row for r in files.numbered(read).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_pages_of_checked_sheets(spark):
    records = spark.createDataFrame([("a", 1, "x <b>"), ("b", 2, "y")], "source_id string, source_row long, case_content string")
    sheet = annotation.gold_worksheet(records, 10)
    assert "\\u003cb>" in files.annotation_page(sheet, "t", checked=True)
    for bad in (sheet.union(sheet), sheet.limit(0), sheet.replace("y", "z", "case_content")):
        with pytest.raises(ValueError):
            files.annotation_page(bad, "t", checked=True)


def test_gold_must_be_finished_and_of_its_text(spark):
    records = spark.createDataFrame([("a", 1, "x y"), ("b", 2, "z")], "source_id string, source_row long, case_content string")
    from pyspark.sql import functions as F

    sheet = annotation.gold_worksheet(records, 1)
    done = sheet.withColumns({"review_status": F.lit("complete"), "annotator_id": F.lit(" n ")})
    assert [(r.source_id, r.annotator_id) for r in annotation.frozen_gold(done, records).collect()] == [("a", "n")]
    bad = [sheet, done.limit(0), done.withColumn("annotator_id", F.lit(" ")), done.withColumn("source_row", F.lit(9)), done.withColumn("source_id", F.lit("q"))]
    for frame in bad:
        with pytest.raises(ValueError):
            annotation.frozen_gold(frame, records)
    with pytest.raises(ValueError, match="changed"):
        annotation.frozen_gold(done, records.withColumn("case_content", F.lit("new")))
    results = extraction.run_extraction(records, extraction.LeadingWords, extraction.Contract("m"), partitions=1, sleep=lambda s: None)
    with pytest.raises(ValueError):
        annotation.gold_worksheet(records, 2, results.where("source_id = 'a'"))


def test_answers_that_were_cut_off(spark):
    class Cut(extraction.LeadingWords):
        def propose(self, text, limits=None):
            if limits is None:
                raise extraction.Truncated
            assert limits == {"quote_chars": 48, "items": 2, "search_terms": 4}
            return super().propose(text)

    events, counts = extraction.extract_document(Cut(), "one two three", 8000)
    assert counts["truncation_recoveries"] == 1 and events[0]["trigger"]["text"] == "one"
    assert extraction.outcome(extraction.UpstreamError(503)) == ("UPSTREAM_HTTP_ERROR", True) and extraction.outcome(extraction.UpstreamError(400)) == ("UPSTREAM_HTTP_ERROR", False)
    assert extraction.outcome(TimeoutError()) == ("UPSTREAM_TIMEOUT", True) and extraction.outcome(ConnectionError())[0] == "UPSTREAM_CONNECTION_ERROR" and not extraction.outcome(ValueError())[1]
    assert len(extraction.Contract("m").terms()) == 10 and json.loads(extraction.user_message("é")) == {"case_content": "é"}
    waits = list(extraction.waits(4, "s"))
    assert waits[0] == 0 and all(0.75 * 2**i <= w <= 1.25 * 2**i for i, w in enumerate(waits[1:]))


def test_cached_results_are_checked(spark):
    records = spark.createDataFrame([("a", 1, "one two three")], "source_id string, source_row long, case_content string")
    contract = extraction.Contract("m")
    run = lambda **o: extraction.run_extraction(records, extraction.LeadingWords, contract, partitions=1, sleep=lambda s: None, **o)
    from pyspark.sql import functions as F

    cache = extraction.cache_rows(run())
    assert run(cache=cache).first().attempts == 0
    for bad in (cache.withColumn("content_sha256", F.lit("x")), cache.withColumn("events", F.regexp_replace("events", '"start":0', '"start":1'))):
        with pytest.raises(Exception, match="a cached result"):
            run(cache=bad).collect()


def test_prefixes_and_columns(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "n long, v string")
    assert tuple(profile.prefix_compare(one.limit(1), one, "n").first()) == (1, True, 0, True)
    assert tuple(profile.prefix_compare(one.union(spark.createDataFrame([(3, "c")], one.schema)), one, "n").first()) == (3, True, 1, False)
    assert tuple(profile.prefix_compare(one.select("n"), one, "n").first()) == (2, False, 2, False)


def test_guards_counts_and_facts(spark, tmp_path):
    from pyspark.sql import functions as F

    from caselens.operators import dataset
    from caselens.streaming import incremental

    rows = spark.createDataFrame([("a", "x"), ("b", "y\tz")], "id string, t string")
    assert dataset.require_clean(rows.where("id = 'a'"), "t").count() == 1
    with pytest.raises(Exception, match="tabular"):
        dataset.require_clean(rows, "t").collect()
    frame, seen = incremental.counted(rows, "seen", long=F.count_if(F.length("t") > 1))
    frame.collect()
    assert seen.get == {"rows": 2, "long": 1}
    with pytest.raises(ValueError):
        incremental.resumed(rows, rows.limit(1), "id", "t", failed=rows)
    assert incremental.resumed(rows, rows.where("id = 'a'"), "id", "t", failed=rows.where("id = 'b'")).count() == 1
    (tmp_path / "t.tsv").write_text("p\tq\tr\n1\t2\t3\n4\n5\t6\n")
    path = f"{tmp_path}/t.tsv"
    assert tuple(files.unavailable_fields(files.record_widths(spark, path), 3).first()) == (4, 2, 3)
    facts = files.source_facts(spark, path)
    assert facts["header"] == ["p", "q", "r"] and facts["sha256"] == files.file_sha256(path) and facts["size_bytes"] == 18
    recorded = spark.createDataFrame([("p1", "h1"), ("p2", "h2")], "path string, sha256 string")
    assert {r.path for r in dense.changed_files(spark.createDataFrame([("p1", "h1"), ("p2", "h9"), ("p3", "h3")], recorded.schema), recorded).collect()} == {"p2", "p3"}
    with pytest.raises(ValueError, match="precision"):
        dense.validate_shards(spark.createDataFrame([(1, 1, [1.0])], "shard int, docid long, embedding array<double>"), 1)
