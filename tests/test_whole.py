"""Queries that must see the whole of their tables, against brute force in Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from caselens import catalog
from caselens.functions import text as T
from caselens.operators import dense, metrics
from caselens.queries import retrieval


def rows(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def test_occurrences_of_the_whole_text(spark, sf):
    want = {d.doc_id: sum(d.text.startswith("an", i) for i in range(len(d.text))) for d in rows(spark, sf, "documents")}
    assert {r.doc_id: r.hits for r in catalog.QUERIES["overlapping_occurrences"](spark, sf).collect()} == want
    assert sum(want.values()) > sum(d.text[:200].count("an") for d in rows(spark, sf, "documents"))


def test_bootstrap_draws_from_all_labels(spark, sf):
    labels = sorted((r.doc_id, float(r.quality), 1.0 - r.toxic) for r in rows(spark, sf, "labels"))
    want = metrics.bootstrap([two - one for _, one, two in labels])
    got = catalog.QUERIES["paired_bootstrap"](spark, sf).first()
    assert [got.delta, got.ci_low, got.ci_high] == pytest.approx([want["delta"], *want["ci"]], abs=1e-12)


def test_bootstrap_in_blocks(spark):
    pairs = [(("a", "b", None)[i % 3], 97 * i % 101, i % 7 / 3, i % 5 / 4) for i in range(100)]
    frame = spark.createDataFrame(pairs, "g string, query_no long, one double, two double")
    got = {r.g: [r.delta, r.ci_low, r.ci_high] for r in metrics.bootstrap_frame(frame, "g", block=8).collect()}
    for g in ("a", "b", None):
        want = metrics.bootstrap([two - one for name, _, one, two in sorted(pairs, key=lambda p: p[1]) if name == g])
        assert got[g] == pytest.approx([want["delta"], *want["ci"]], abs=1e-12)


def test_catalog_is_of_all_documents(spark, sf, tmp_path):
    docs = [(1, "one", "en", "odd", 3), (2, "two", "en", "even", 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.knowledge_id for r in retrieval._catalog(spark, str(tmp_path)).collect()} == {"en:odd", "en:even"}


def nearest(vectors, queries, score, k):
    """query id: ids of the best k, by brute force."""
    return {q: sorted(vectors, key=lambda v, q=q: (-round(score(vectors[q], vectors[v]), 9), v))[:k] for q in queries}


def in_order(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.docid)
    return out


def test_every_vector_is_searched(spark, sf):
    e = rows(spark, sf, "embeddings")
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in e}
    queries = [v for v in vectors if v % 50 == 0]
    even = {r.vec_id: vectors[r.vec_id] for r in e if r.label % 2 == 0}
    assert in_order(catalog.QUERIES["dense_topk"](spark, sf)) == nearest(vectors, queries, np.dot, 10)
    allowed = {q: [v for v in found if v in even][:10] for q, found in nearest(vectors, queries, np.dot, len(vectors)).items()}
    assert in_order(catalog.QUERIES["dense_filtered_topk"](spark, sf)) == allowed
    routes = nearest(vectors, queries, np.dot, 50), nearest(vectors, queries, lambda a, b: -np.abs(a - b).sum(), 50)
    for r in catalog.QUERIES["hybrid_rrf"](spark, sf).collect():
        for route, rank in zip(routes, (r.rank_one, r.rank_two), strict=True):
            assert rank == (route[r.query_id].index(r.docid) + 1 if r.docid in route[r.query_id] else 0)
    assert {r.query_id for r in catalog.QUERIES["dense_vote"](spark, sf).collect()} == set(queries)


def test_search_in_blocks(spark):
    draw = np.random.default_rng(0)
    vectors = {i: draw.integers(-3, 4, 5).astype(np.float64) for i in range(60)}
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "id long, v array<float>")
    assert in_order(dense.inner_product_topk(frame, frame, 7, block=8)) == nearest(vectors, vectors, np.dot, 7)
    assert in_order(dense.inner_product_topk(frame.limit(0), frame, 7)) == in_order(dense.inner_product_topk(frame, frame.limit(0), 7)) == {}


def test_quotes_are_grounded_wherever_they_occur(spark, sf, tmp_path):
    spark.createDataFrame([(1, "\U0001f600 aXa aXaXa"), (2, "none")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "aXa"), (8, "no")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, catalog.QUERIES["ground_quotes"](spark, str(tmp_path)).collect()))
    assert got == [(1, 7, 2, 5), (1, 7, 6, 9), (1, 7, 8, 11), (2, 8, 0, 2)]


def test_redaction_reads_the_whole_text(spark, sf, tmp_path):
    far = "x" * 200
    texts = [f"{far} a@b.co", f"{far} 13800138000", f"{far} {'1' * 24}", far, "short", "a\tb", "a\x01"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pii = "|".join((T.MOBILE, T.CITIZEN_ID, T.EMAIL))

    def kind(text):
        if re.search(pii, text):
            return "<REDACTED_PII_LIKE>"
        if re.search(r"\d{7,}", text):
            return "<REDACTED_LONG_NUMBER>"
        return "<REDACTED_UNSAFE_VALUE>" if len(text) > 120 or re.search(T.CONTROL, text) else "shown"

    for folder, every in ((str(tmp_path), texts), (sf, [d.text for d in rows(spark, sf, "documents")])):
        assert {r.kind: r.rows for r in catalog.QUERIES["redaction"](spark, folder).collect()} == dict(Counter(map(kind, every)))


def test_titles_hold_whole_texts(spark, sf):
    docs, words = rows(spark, sf, "documents"), lambda t: re.findall("[a-z0-9]+", t.lower())
    texts = {}
    for d in docs:
        texts.setdefault(f"{d.lang}:{d.source}", set()).add(d.text)
    tf = {k: Counter(w for t in own for w in words(t)) for k, own in texts.items()}
    mean, df = sum(c.total() for c in tf.values()) / len(tf), Counter(w for c in tf.values() for w in c)
    idf = lambda w: max(math.log((len(tf) - df[w] + 0.5) / (df[w] + 0.5)), 0) or 1e-6
    want = {}
    for item in rows(spark, sf, "benchmark"):
        asked = Counter(words(item.text))
        heavy = sorted((w for w in asked if df[w]), key=lambda w: (-min(asked[w], 3) / math.log2(df[w] + 2), w))[:32]
        for k, c in tf.items():
            if any(c[w] for w in heavy):
                want[item.item_id, k] = -sum(idf(w) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for w in heavy)
    got = catalog.QUERIES["bm25_titles_topk"](spark, sf).collect()
    assert len(got) == sum(min(10, sum(q == item.item_id for q, _ in want)) for item in rows(spark, sf, "benchmark"))
    for r in got:
        assert r.score == pytest.approx(want[r.query_id, r.knowledge_id], abs=2e-6)
        assert r["rank"] - 1 <= sum(s <= r.score + 2e-6 for (q, _), s in want.items() if q == r.query_id)


def test_the_whole_vocabulary(spark, sf):
    df, cf = Counter(), Counter()
    for text in {d.text for d in rows(spark, sf, "documents")}:
        words = re.findall("[a-z0-9]+", text.lower())
        cf.update(words)
        df.update(set(words))
    assert {r.term: (r.df, r.cf) for r in catalog.QUERIES["vocab_df"](spark, sf).collect()} == {w: (df[w], cf[w]) for w in df}


def test_every_document_is_split(spark, sf, tmp_path):
    docs = [(1, "x" * 2500, None), (2, "short", 5), (3, "", 0), (4, "y. \n" * 400, 1600)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (str(tmp_path), sf):
        want = sorted((d.doc_id, n, at, len(part)) for d in rows(spark, folder, "documents") for n, (at, part) in enumerate(T.segments(d.text, 1000)))
        assert sorted(map(tuple, catalog.QUERIES["split_documents"](spark, folder).collect())) == want
