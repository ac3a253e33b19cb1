import pytest
from pyspark.sql import functions as F

from caselens.operators import address, dataset, dense, fusion, judging, lexical, metrics, scoring
from caselens.operators.graph import connected_components
from caselens.plans.scratch import Scratch
from caselens.plans.search import Searcher


def record(i, content, time="2025-08-01 10:00:00", order=None, quote="[]", flag="0", invalid=""):
    return (i, order if order is not None else i, content, time, flag, invalid, "ignored", quote, int(i.strip("abcdefghijklmnopqrstuvwxyz-") or 0))


COLUMNS = "id string, order_id string, case_content string, call_time string, delete_flag string, order_invalid_type string, case_accord_type_one_name string, knowledge_quote string, source_row long"


def quote(key, title):
    return f'[{{"type":0,"value":"{key}","label":"{title}"}}]'


@pytest.fixture(scope="module")
def built(spark):
    rows = [
        record("r1", "道路积水严重", quote=quote("drain", "排水")), record("r2", "道路积水 严重", quote=quote("drain2", "排水二")), record("r3", "垃圾堆放", quote=quote("waste", "垃圾")),
        record("r4", "路灯不亮", order="o1"), record("r5", "路灯修好", "2026-01-05 10:00:00", "o1"), record("r6", "", ), record("r7", "a\tb"), record("r8", "删掉", flag="1"), record("r9", "无效", invalid="x"),
        record("r10", "新的积水问题", "2026-01-10 10:00:00", quote=quote("drain", "排水")), record("r11", "测试积水", "2026-02-10 10:00:00"), record("r12", "没时间", "NULL"), record("r13", "坏引用", quote="broken"),
    ]
    return dataset.build_dataset(spark.createDataFrame(rows, COLUMNS), Scratch(spark, "test"))


def test_dataset(built):
    assert {r.reason: r["count"] for r in built["excluded"].collect()} == {"empty_content": 1, "embedded_tabular_data": 1, "deleted_or_unknown_delete_flag": 1, "marked_invalid": 1}
    got = {r.source_id: r for r in built["records"].collect()}
    assert got["r1"].group_id == got["r2"].group_id == 1 and got["r1"].text_hash == got["r2"].text_hash
    assert {k: r.split for k, r in got.items()} == {"r1": "corpus", "r2": "corpus", "r3": "corpus", "r4": "cross_period", "r5": "cross_period", "r10": "dev", "r11": "test", "r12": "missing_time", "r13": "corpus"}
    assert got["r13"].ref_error == "invalid_reference_json" and built["corpus"].count() == 3
    assert {(r.docid, r.knowledge_id) for r in built["links"].collect()} == {(1, "0:drain"), (1, "0:drain2"), (3, "0:waste")}
    sample, stats = dataset.query_set(built["records"], "dev", 10, 42, built["catalog"])
    s = stats.first()
    assert sample.first().gold == ["0:drain"] and (s.queries, s.labeled, s.targets, s.in_catalog, s.unseen) == (1, 1, 1, 1, 0)


def test_references(spark):
    values = ["NULL", "broken", '{"type":0}', '[{"type":true,"value":1,"label":"x"}]', "[]", '[{"type":1,"value":" k ","label":" L "},{"type":1,"value":"k","label":"L"}]', '[{"type":1,"value":"k","label":5}]']
    out = dataset.references(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, q string"), "q").orderBy("i").collect()
    assert [r.ref_error for r in out] == [None, "invalid_reference_json", "invalid_reference_list", "invalid_reference_item", None, None, "invalid_reference_item"]
    assert [tuple(x) for x in out[5].refs] == [("1:k", "L")]


def test_components_and_uniqueness(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    labels = {r.node: r.label for r in connected_components(chain, Scratch(spark, "test")).collect()}
    assert set(labels.values()) == {0, 100} and labels[60] == 0
    with pytest.raises(ValueError):
        dataset.require_unique(spark.createDataFrame([(1,), (1,)], "x int"), "x")


def test_metrics(spark):
    ranked = spark.createDataFrame([("a", ["k1", "k2"], ["k1", "x"]), ("b", ["new"], ["x"]), ("c", [], ["k1"])], "query_id string, gold array<string>, ranking array<string>")
    catalog = spark.createDataFrame([("k1",), ("k2",)], "knowledge_id string")
    m = metrics.observed_metrics(ranked, catalog).first()
    assert (m.observed_recall_10, m.catalog_recall_ceiling, m.known_target_recall_10, m.known_target_queries, m.unlabeled_queries) == (0.25, 0.5, 0.5, 1, 1)
    assert m.target_catalog_coverage == pytest.approx(2 / 3)
    assert metrics.observed_metrics(ranked.limit(0), catalog).first().observed_recall_1 is None
    with pytest.raises(ValueError):
        metrics.observed_metrics(spark.createDataFrame([("a", ["k"], ["x", "x"])], ranked.schema), catalog)


def hits(spark, *rows):
    return spark.createDataFrame([(0, d, r) for r, d in enumerate(rows, 1)], "query_id long, docid string, rank int")


def test_fusion(spark):
    fused = fusion.rrf({"bm25": hits(spark, "shared", "lexical"), "dense": hits(spark, "semantic", "shared")}, 10, "docid").orderBy("rank").collect()
    assert [r.docid for r in fused] == ["shared", "semantic", "lexical"] and fused[0].score == pytest.approx(1 / 61 + 1 / 62) and fused[0].route_ranks == {"bm25": 1, "dense": 2}
    tied = fusion.rrf({"x": hits(spark, "z", "a"), "y": hits(spark, "a", "z")}, 10, "docid").orderBy("rank").collect()
    assert [r.docid for r in tied] == ["a", "z"]


def test_votes_of_one_group_count_once(spark):
    links = spark.createDataFrame([("old-a", "x"), ("old-b", "x"), ("ind", "y")], "docid string, knowledge_id string")
    groups = spark.createDataFrame([("old-a", 1), ("old-b", 1), ("ind", 2)], "docid string, group_id long")
    out = fusion.vote(hits(spark, "old-a", "old-b", "ind"), links, groups).orderBy("rank").collect()
    assert [(r.knowledge_id, round(r.score, 9)) for r in out] == [("x", round(1 / 61, 9)), ("y", round(1 / 63, 9))] and out[0].supporting == ["old-a", "old-b"]


def test_judged_metrics_and_calibration(spark):
    rows = [(q, "problem", m, r, g) for q in (1, 2) for m, gs in (("baseline", [0, 2, 2]), ("reranked", [2, 2, 0])) for r, g in enumerate(gs, 1)]
    judged = spark.createDataFrame(rows, "query_id int, mode string, method string, rank int, grade int")
    pool = judged.where("method = 'baseline'").select("query_id", "mode", "grade")
    out = {(r.mode, r.method): r for r in metrics.summarised(metrics.judged_metrics(judged, pool)).collect()}
    b, r = out["all", "baseline"], out["problem", "reranked"]
    assert b.mean_precision == 0.4 and b.returned_precision == pytest.approx(2 / 3) and r.mean_ndcg == pytest.approx(1) and b.mean_ndcg < 1 and b.mean_returned == 3
    with pytest.raises(ValueError):
        metrics.judged_metrics(judged.withColumn("grade", F.lit(None).cast("int")), pool)
    scored = spark.createDataFrame([("m", q, float(s), s > 2) for q in range(3) for s in range(6)], "mode string, query_id int, score double, relevant boolean")
    t = metrics.calibrate(scored).first()
    assert (t.threshold, t.results, t.queries, t.precision) == (3.0, 9, 3, 1.0) and metrics.calibrate(scored, min_queries=4).count() == 0


def test_reranking_and_policies(spark):
    rows = spark.createDataFrame([(0, "a b", "d1", "b", 1), (0, "a b", "d2", "a b", 2), (0, "a b", "d3", "c", 3)], "query_id long, query string, docid string, content string, rank int")
    out = judging.rerank(rows, judging.OverlapReranker)
    assert [(r.docid, r.retrieval_rank) for r in out.orderBy("rank").collect()] == [("d2", 2), ("d1", 1), ("d3", 3)]
    kept, status = judging.select_results(out, rows, 2, 0.9)
    assert [r.docid for r in kept.collect()] == ["d2"] and status.first().result_status == "fewer_than_requested" and status.first().rejected == 2
    assert judging.select_results(out, rows, 2)[1].first().result_status == "results_available"
    judging.validate_runs(rows.select("query_id", "docid", "rank"), out)
    policy = {"version": judging.POLICY_VERSION, "max_top_k": 5, "modes": {"problem": {"threshold": 0.5, "context": {"a": 1}}}}
    assert judging.policy_threshold(policy, "problem", {"a": 1}, 5) == 0.5
    for bad in (({"a": 2}, 5), ({"a": 1}, 6)):
        with pytest.raises(ValueError):
            judging.policy_threshold(policy, "problem", *bad)
    queries = judging.seed_queries(spark, [(f"p{i}", f"a{i}") for i in range(10)])
    assert judging.validate_queries(queries).count() == 30 and queries.where("partition = 'calibration'").count() == 18
    with pytest.raises(ValueError):
        judging.validate_queries(queries.withColumn("address", F.lit("x")))
    pool = judging.judgment_pool(rows, out.where("rank = 1"), 2)
    assert {r.docid for r in pool.collect()} == {"d1", "d2"}


def test_scoring(spark):
    issues = [("active", "i1", True, "occurred", ["积水"]), ("active", "i2", False, "occurred", ["漏水"]), ("background", "b1", False, None, [])]
    gold = spark.createDataFrame([("s1", 1, "h1", "open", issues), ("s2", 2, "h2", "open", [])], scoring.GOLD)
    predictions = spark.createDataFrame([("s1", 1, "h1", "p1", None, [("occurred", ["路面积水"]), ("occurred", ["x"]), ("occurred", [])]), ("s2", 2, "h2", "p2", None, [])], scoring.PREDICTION)
    judged = spark.createDataFrame([("s1", "p1", [(0, "active", "i1"), (1, "background", "b1")], [2]), ("s2", "p2", [], [])], scoring.ADJUDICATION)
    out = scoring.score(gold, predictions, judged).first()
    third, half = pytest.approx(1 / 3), 0.5
    assert (out.issue_precision, out.issue_recall, out.current_request_recall, out.background_leakage_rate, out.spurious_issue_rate) == (third, half, 1.0, third, third)
    assert (out.active_polarity_accuracy, out.active_evidence_quote_recall, out.matched_issue_evidence_quote_recall, out.exact_record_rate) == (1.0, half, 1.0, half)
    assert (out.case_status_prediction_coverage, out.case_status_accuracy) == (0.0, None)
    with pytest.raises(ValueError):
        scoring.score(gold, predictions, judged.where("source_id = 's1'"))
    with pytest.raises(ValueError):
        scoring.score(gold, predictions, judged.withColumn("spurious", F.array().cast("array<int>")))
    sources = spark.createDataFrame([("s1", "路面积水和漏水"), ("s2", "")], "source_id string, case_content string")
    scoring.validate_gold(gold, sources)
    with pytest.raises(ValueError):
        scoring.validate_gold(gold, sources.withColumn("case_content", F.lit("")))


@pytest.fixture(scope="module")
def searcher(spark):
    texts = ["幸福小区3号楼门口积水", "幸福小区排水慢", "幸福小区5号楼渗水", "劳动东路3号积水", "劳动东路23号垃圾", "平安花园积水", "武进区幸福小区3号楼渗水"]
    cases = spark.createDataFrame([(i, f"old-{i}", i, t, "2025-08-01 10:00:00") for i, t in enumerate(texts, 1)], "docid long, source_id string, source_row long, content string, call_time string").cache()
    encoder = dense.HashEncoder(16)
    vectors = dense.encode_frame(cases, encoder, "content").select("docid", "embedding").cache()
    return Searcher(cases, lexical.build_index(cases, "docid", "content"), vectors, encoder, encoder.identity, address.build_address_index(cases))


def ids(frame):
    return [r.source_id for r in frame.collect()]


def test_search_modes(searcher):
    assert ids(searcher.search("幸福小区3号楼", "address")) == ["old-1", "old-7"]
    assert ids(searcher.search("武进区幸福小区3号楼", "address")) == ["old-7"]
    assert ids(searcher.search("劳动东路3号", "address")) == ["old-4"] and ids(searcher.search("劳动东路23号", "address")) == ["old-5"]
    assert ids(searcher.search("幸福小区99号楼", "address")) == []
    broad = searcher.search("幸福小区99号楼", "address", allow_broader=True).collect()
    assert [r.source_id for r in broad] == ["old-1", "old-2", "old-3", "old-7"] and broad[0].address.scope == "broader_named_place" and broad[0].address.broader
    assert ids(searcher.search("完全没有", retriever="bm25")) == []
    first = searcher.search("小区积水", retriever="bm25", top_k=3).collect()
    assert first[0].source_id in ("old-1", "old-6") and "积水" in first[0].shared_keywords
    for retriever in ("dense", "hybrid"):
        assert len(ids(searcher.search("积水", retriever=retriever, top_k=3))) == 3


def test_address_pool_filters_before_the_cut(searcher):
    for retriever in ("bm25", "dense", "hybrid"):
        got = ids(searcher.search("垃圾积水", "combined", retriever, address_text="劳动东路23号", top_k=1, case_k=1))
        assert got == ["old-5"], retriever
    assert ids(searcher.search("积水", "combined", "bm25", address_text="无名大厦", top_k=1)) == []
    got = searcher.search("积水", "combined", "bm25", address_text="幸福小区", reranker=judging.OverlapReranker, top_k=2).collect()
    assert all(r.rerank_score is not None for r in got)
    for bad in ({"mode": "combined"}, {"top_k": 0}, {"retriever": "x"}, {"mode": "address", "reranker": judging.OverlapReranker}):
        with pytest.raises(ValueError):
            searcher.search("幸福小区", **bad)
