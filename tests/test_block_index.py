"""The block index against BM25 in plain Python, and how much of it a search reads."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caselens.functions.text import token_list, tokens
from caselens.operators import lexical


def brute(docs, query, k, max_terms=32):
    counts = {d: Counter(t.split()) for d, t in docs.items()}
    n, avg = len(docs), sum(sum(c.values()) for c in counts.values()) / len(docs)
    df = Counter(t for c in counts.values() for t in c)
    asked = Counter(query.split())
    terms = sorted((t for t in asked if df[t]), key=lambda t: (-min(asked[t], 3) / math.log2(df[t] + 2), t))[:max_terms]
    scores = {}
    for t in terms:
        idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5))
        idf = lexical.IDF_FLOOR if idf <= 0 else idf
        for d, c in counts.items():
            if c[t]:
                scores[d] = scores.get(d, 0) - idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg))
    return sorted(((d, round(s, 6)) for d, s in scores.items()), key=lambda x: (round(scores[x[0]], 9), x[0]))[:k]


@pytest.fixture(scope="module")
def corpus(spark):
    """2,000 documents on 40 topics; common words everywhere, a few empty ones."""
    rng = random.Random(1)
    docs = {}
    for d in range(2000):
        words = rng.choices([f"common{i}" for i in range(30)], k=rng.randint(5, 60)) + rng.choices([f"topic{d % 40}x{i}" for i in range(50)], k=rng.randint(3, 40))
        rng.shuffle(words)
        docs[d] = "" if d % 500 == 7 else " ".join(words)
    frame = spark.createDataFrame(list(docs.items()), "docid long, text string").repartition(6)
    queries = {q: " ".join([f"common{i}" for i in rng.sample(range(30), 5)] + [f"topic{q}x{i}" for i in rng.sample(range(50), 6)]) for q in range(12)}
    queries[90], queries[91] = "common1 common2", "nowhere"
    return docs, frame, queries, spark.createDataFrame(list(queries.items()), "query_id long, query string"), lexical.build_index(frame, "docid", "text")


@pytest.mark.parametrize("k", [1, 10, 300])
def test_best_documents_are_those_of_a_full_scan(corpus, k):
    docs, _, queries, asked, index = corpus
    got = {}
    for r in lexical.bm25(asked, index, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.docid, round(r.score, 6)))
    assert got == {q: want for q, text in queries.items() if (want := brute(docs, text, k))}


def test_strips_below_the_bar_are_not_read(corpus):
    asked, index = corpus[3:]
    rows = {r.query_id: r for r in lexical.postings_read(asked.where("query_id < 50"), index, 10).collect()}
    assert sum(r.read for r in rows.values()) < 0.6 * sum(r.postings for r in rows.values())
    assert all(r.read <= r.postings for r in rows.values())


def test_bounds_hold_for_every_document(corpus):
    index = corpus[4]
    n, avgdl = index.stats.first()
    each = index.blocks.select("bound", F.explode("docs").alias("d")).select("bound", lexical.weight(F.col("d.tf"), F.col("d.dl"), avgdl).alias("w"))
    assert each.where("w > bound").isEmpty() and n == 2000
    assert index.blocks.agg(F.max(F.size("docs"))).first()[0] <= 4 * lexical.STRIP


def test_a_pool_by_area(corpus, spark):
    docs, frame, queries, asked, index = corpus
    filed = frame.select("docid", (F.col("docid") % 3).alias("area"))
    allowed = asked.select("query_id", (F.col("query_id") % 3).alias("area"))
    pairs = allowed.join(filed, "area").select("query_id", "docid")
    rows = lambda hits: sorted((r.query_id, r.rank, r.docid) for r in hits.collect())
    by_area = rows(lexical.bm25(asked, index, 10, allowed=allowed, filed=filed))
    assert by_area == rows(lexical.bm25(asked, index, 10, allowed=pairs)) and len(by_area) > 100


def test_parts_of_a_document(spark):
    whole = spark.createDataFrame([("a", "red red blue"), ("b", "blue green"), ("c", "")], "docid string, text string")
    parts = spark.createDataFrame([("a", "red"), ("a", "red blue"), ("b", "blue"), ("b", ""), ("b", "green"), ("c", ""), ("c", None)], "docid string, text string")
    one, two = lexical.build_index(whole, "docid", "text"), lexical.build_index(parts, "docid", "text", parts=True)
    for name in ("lengths", "vocabulary", "stats", "postings"):
        assert sorted(map(tuple, getattr(one, name).collect())) == sorted(map(tuple, getattr(two, name).collect()))


def test_a_stored_index_answers_alike(corpus, spark, tmp_path):
    asked, index = corpus[3:]
    index.write(f"{tmp_path}/index")
    rows = lambda i: sorted(map(tuple, lexical.bm25(asked, i, 5).select("query_id", "docid", "rank").collect()))
    assert rows(lexical.Index.read(spark, f"{tmp_path}/index")) == rows(index)


def test_both_tokenizers_agree(spark):
    odd = [None, "", "Plain WORDS 12x", "[name] said [PHONE] [other]", "\u4e2d\u6587\u5b57 a\u4e2d b\u4e2d\u6587", "\uff21\uff22 \u212a\u0130 \u00df\u00c9", "\u3400\u9fff\u3001x", "e\u0301 \u00bd \u2460 \uf900", "a_b-c.d'e", "\x00 tab\tx"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    got = {r.i: r.k or [] for r in frame.select("i", tokens(F.col("t")).alias("k")).collect()}
    assert [got[i] for i in range(len(odd))] == [token_list(t) for t in odd]


def test_no_documents(spark):
    index = lexical.build_index(spark.createDataFrame([], "docid long, text string"), "docid", "text")
    asked = spark.createDataFrame([(1, "word")], "query_id long, query string")
    assert lexical.bm25(asked, index).count() == 0
