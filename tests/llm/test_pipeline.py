import re
from collections import Counter

import corpus_pipeline


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages_follow_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "substring_dedup", "best_fit_packing"]
    kept, seen = docs, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == docs.columns, name
        rows = {r.doc_id: r.text for r in out.collect()}
        assert set(rows) <= set(seen) and len(rows) == out.count()
        if name != "substring_dedup":
            assert all(seen[d] == t for d, t in rows.items())
        if name == "exact_dedup":
            texts = [exact_text(t) for t in rows.values()]
            assert len(set(texts)) == len(texts) == len({exact_text(t) for t in seen.values()})
        if name == "substring_dedup":
            assert set(rows) == set(seen)
            windows = [tuple(w[i : i + 35]) for w in map(words, seen.values()) for i in range(len(w) - 34)]
            repeated = {w for w, n in Counter(windows).items() if n > 1}
            for d, t in rows.items():
                w = words(seen[d])
                gone = {i + k for i in range(len(w) - 34) if tuple(w[i : i + 35]) in repeated for k in range(35)}
                assert t == (" ".join(x for i, x in enumerate(w) if i not in gone) if gone else seen[d])
            assert all(r.n_chars == len(r.text or "") for r in out.collect())
        kept, seen = spark.createDataFrame(out.collect(), docs.schema), rows
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()
    assert {r.doc_id for r in packed} == set(seen) and sum(r.n_words for r in packed) == sum(len(words(t)) for t in seen.values())
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, packed))


def exact_text(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_odd_rows_pass_all_stages(spark, sf, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame((out := stage(spark, docs, sf)).collect(), out.schema)
    assert docs.where("doc_id = 9").count() > 0 and docs.where("doc_id in (4, 5, 6, 7, 11, 12)").count() == 0


def test_no_rows_pass_all_stages(spark, sf, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.count() == 0
