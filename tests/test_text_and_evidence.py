import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from caselens.functions import address, evidence
from caselens.functions import text as T
from caselens.operators import dense, extraction, metrics


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r.x for r in rows.select("i", f(F.col("c")).alias("x")).orderBy("i").collect()]


def test_null_words(spark):
    assert column(spark, [None, "", "  ", "NULL", "null", "NaN", "n/a", "NA", " x　"], T.semantic_value) == [None] * 8 + ["x"]
    assert column(spark, [None, "none", "na", "\x1c a "], T.dataset_value) == ["", "", "na", "a"]
    assert column(spark, [None, " NULL ", "none", " a"], T.loader_value) == ["", "", "none", " a"]


def test_tokens(spark):
    got = column(spark, ["道路积水 [PHONE] ABC", "水", "ＡＢＣ１２ x", "", None, "a-b 积水a"], T.tokens)
    assert got == [["道路", "路积", "积水", "abc"], ["水"], ["abc12", "x"], [], None, ["a", "b", "积水", "a"]]


def test_redaction(spark):
    got = column(spark, ["13800138000", "1" * 24, "a@b.co", "plain", "x" * 121, "a\x01"], T.safe_display)
    assert got == ["<REDACTED_PII_LIKE>", "<REDACTED_LONG_NUMBER>", "<REDACTED_PII_LIKE>", "plain", "<REDACTED_UNSAFE_VALUE>", "<REDACTED_UNSAFE_VALUE>"]


def test_small_functions(spark):
    assert column(spark, [0, 1, 3, 1024, 1025], T.power_bucket, "long") == [0, 1, 2, 1024, 1024]
    assert column(spark, [50, 51, 2000, 2001], T.length_bucket, "int") == ["01_le_50", "02_51_200", "04_501_2000", "05_gt_2000"]
    assert column(spark, ["aaa", "a", "", "ba\U0001f600aa"], lambda c: T.occurrences(c, F.lit("aa"))) == [[0, 1], [], [], [3]]
    assert column(spark, ["=1", "  @x", "+a", "a=b"], T.safe_cell) == ["'=1", "'  @x", "'+a", "a=b"]
    times = ["2025-12-31 23:59:59", "2026-01-01 00:00:00", "2026-2-1 1:2:3", "2026-01-32 00:00:00", "x", None]
    assert column(spark, times, lambda c: T.period(c, "2026-01-01", "2026-02-01")) == [1, 2, 4, 8, 8, 8]
    assert [x is not None for x in column(spark, ["2025-01-02", "2025-01-02T03:04:05", "2025-13-01", "02.01.2025"], T.iso_time)] == [True, True, False, False]
    assert column(spark, ["a b", "ａ b"], T.content_key)[0] == column(spark, ["a b", "ａ b"], T.content_key)[1]


def test_segments_are_lossless():
    text = "甲" * 700 + "。" + "甲" * 700 + "。"
    parts = T.segments(text, 1000)
    assert len(parts) == 2 and "".join(p for _, p in parts) == text and parts[1][0] == 701
    assert T.segments("", 1000) == [(0, "")] and [len(p) for _, p in T.segments("x" * 2500, 1000)] == [1000, 1000, 500]
    with pytest.raises(ValueError):
        T.segments("x", 999)


def test_vectors_at_unit_length(spark):
    assert [round(x, 6) for x in dense.normalised([[3, 4, 0]], 3)[0].tolist()] == [0.6, 0.8, 0.0]
    for bad in ([[0.0, 0, 0]], [[float("nan"), 1, 1]], [[1.0, 2]]):
        with pytest.raises(ValueError):
            dense.normalised(bad, 3)
    assert [round(x, 6) for x in column(spark, [[3.0, 4.0, 0.0]], lambda c: T.unit_vector(c, 3), "array<float>")[0]] == [0.6, 0.8, 0.0]


def test_bootstrap():
    assert metrics.bootstrap([0.5, 0.5])["ci"] == [0.5, 0.5] and metrics.bootstrap([])["delta"] is None


def kinds(text):
    return [(e["kind"], e["text"], e["address_group"]) for e in address.parse_address(text)]


def test_addresses():
    assert kinds("市民反映位于幸福小区3号楼漏水") == [("named_place", "幸福小区", 0), ("building", "3号楼", 0)]
    assert kinds("劳动东路23号") == [("road", "劳动东路", 0), ("house_number", "23号", 0)]
    assert kinds("常州市武进区幸福小区") == [("city", "常州市", 0), ("district", "武进区", 0), ("named_place", "幸福小区", 0)]
    assert kinds("附近小区很吵") == [] and kinds("幸福小区。平安花园") == [("named_place", "幸福小区", 0), ("named_place", "平安花园", 1)]
    for e in address.parse_address("前ﬁ幸福小区３号楼"):
        assert "前ﬁ幸福小区３号楼"[e["start"] : e["end"]] == e["text"]
    for bad in ("幸福小区3号楼2单元", "幸福小区二期", "漏水了", "幸福小区3号楼5号楼", "幸福小区。平安花园"):
        with pytest.raises(ValueError):
            address.query_entities(bad)


def quotes(*texts):
    return [{"text": t} for t in texts]


def event(kind="积水", trigger="积水", polarity="occurred", **fields):
    return {"normalized_event_type": kind, "trigger": {"text": trigger}, "polarity": polarity, "search_terms": ["积水", "积水"], **fields}


SOURCE = "幸福小区积水严重，居民希望排水；积水未退"


def test_grounding():
    out, counts = evidence.ground([event(behaviors=quotes("积水"), requests=quotes("希望排水"), locations=[{"evidence": {"text": "幸福小区"}, "kind": "poi", "normalized_name": None}], actors=quotes("居民", "没有"))], SOURCE)
    assert out[0]["locations"][0]["evidence"]["start"] == 0 and counts["rejected_evidence_quotes"] == 1 and counts["proposed_evidence_quotes"] == 6
    assert counts["grounded_spans"] == 5 and out[0]["search_terms"] == ["积水"] and counts["ambiguous_matches"] == 2
    again, _ = evidence.ground([event(), event("积水二")], SOURCE)
    assert [e["trigger"]["start"] for e in again] == [4, 16]
    fallback, counts = evidence.ground([event(trigger="没有", objects=quotes("居民"))], SOURCE)
    assert fallback[0]["trigger"]["text"] == "居民" and (counts["trigger_fallbacks"], counts["rejected_evidence_quotes"]) == (1, 1)
    assert evidence.ground([event("疑似积水")], SOURCE)[0][0]["polarity"] == "possible" and evidence.ground([], SOURCE)[0] == []
    with pytest.raises(evidence.EvidenceError) as e:
        evidence.ground([event(trigger="无", actors=quotes("甲", "乙", "丙"))], SOURCE)
    assert e.value.code == "NO_GROUNDED_EVENTS" and e.value.counts["proposed_evidence_quotes"] == e.value.counts["rejected_evidence_quotes"] == 4 and e.value.counts["dropped_events"] == 1


def test_alignment_shift_merge_views():
    assert evidence.align({"text": "积水", "start": 4, "end": 6}, SOURCE) == ({"text": "积水", "start": 4, "end": 6}, False)
    assert evidence.align({"text": "积水", "start": 15, "end": 17}, SOURCE) == ({"text": "积水", "start": 16, "end": 18}, True)
    for span in ({"text": "积水", "start": 10, "end": 12}, {"text": "无", "start": 0, "end": 1}):
        with pytest.raises(evidence.EvidenceError):
            evidence.align(span, SOURCE)
    one, _ = evidence.ground([event(requests=quotes("希望排水"), locations=[{"evidence": {"text": "幸福小区"}, "kind": "poi", "normalized_name": None}])], SOURCE)
    moved = evidence.shift(one, 100)
    assert moved[0]["trigger"]["start"] == 104 and evidence.align_events(moved, "x" * 100 + SOURCE)[1] == 0
    both = evidence.merge([one, moved])
    assert len(both) == 1 and both[0]["trigger"]["start"] == 4 and len(both[0]["requests"]) == 2
    with pytest.raises(evidence.EvidenceError):
        evidence.merge([[{**one[0], "normalized_event_type": str(i)} for i in range(4)]])
    shown = evidence.views(one)
    assert [k for k, v in shown.items() if "幸福小区" in v] == ["semantic_with_location"] and "诉求：希望排水" in shown["semantic_with_request"]
    assert evidence.event_evidence(one[0]) == ["积水", "希望排水", "幸福小区"]


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


class Model:
    identity = {"kind": "fixed"}

    def propose(self, text):
        if "坏" in text:
            raise extraction.UpstreamError(429)
        return [event()] if "积水" in text else [event(trigger="没有")]


def test_extraction_run(spark):
    contract = extraction.Contract("m")
    records = spark.createDataFrame([("a", 1, SOURCE), ("b", 2, SOURCE), ("c", 3, "坏的"), ("d", 4, "别的")], "source_id string, source_row long, case_content string")
    out = extraction.run_extraction(records, Model, contract, partitions=2, sleep=lambda s: None).cache()
    got = {r.source_id: r for r in out.collect()}
    assert got["a"].events == got["b"].events and got["c"].error_code == "UPSTREAM_RATE_LIMITED" and got["c"].attempts == 2 and got["d"].error_code == "NO_GROUNDED_EVENTS" and got["d"].attempts == 1
    assert extraction.accepted(out).count() == 2 and "case_content" not in extraction.quarantined(out).columns
    cached = extraction.cache_rows(out)
    assert cached.count() == 1
    again = extraction.run_extraction(records.where("source_id <> 'b'"), Model, contract, cached, out.where("source_id = 'c'"), 2, lambda s: None)
    assert {(r.source_id, r.attempts) for r in again.collect()} == {("a", 0), ("d", 1)}
    a = extraction.audit(out).first()
    assert (a.records, a.succeeded, a.failed, a.retries, a.dropped_events) == (4, 2, 2, 1, 1)
    assert {(r.what, r.value): r["count"] for r in extraction.histograms(out).collect()}["polarity", "occurred"] == 2


def test_settled_signs_are_left_alone(spark):
    import re
    import unicodedata

    settled = [chr(i) for i in range(0x11000) if not 0xD800 <= i < 0xE000 and re.match(f"[{T.SETTLED}]", chr(i))]
    assert len(settled) > 27_000 and all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in settled)
    # No two of them make another sign together.
    assert all(unicodedata.is_normalized("NFKC", a + b) for a in settled[:600] for b in settled[:600])
    rows = ["ﬁé", "é é", "plain", "ｆｕｌｌ宽", "é", "a b", None]
    got = [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").orderBy("i").select(T.nfkc(F.col("t"))).collect()]
    assert got == [r and unicodedata.normalize("NFKC", r) for r in rows]
