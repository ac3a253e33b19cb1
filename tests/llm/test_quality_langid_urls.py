import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caselens.llm import langid, quality, queries, urlrules


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(tri)
    covered = {i + k for i, t in enumerate(tri) if often[t] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts_match_brute_force(spark, sf, odd_docs):
    for docs in (odd_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        out = quality.base_rules(docs.select("doc_id", "text")).collect()
        for r in out:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text)


def test_scores_match_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    trusted, buckets = quality.trusted_ids(labels), 512
    ids = {r.doc_id for r in trusted.collect()}
    hashed = {}
    pairs = {(a, b) for d in docs.collect() for w in [words(d.text)] for a, b in zip(w, w[1:], strict=False)}
    singles = {x for d in docs.collect() for x in words(d.text)}
    for r in spark.createDataFrame([(s,) for s in singles], "a string").select("a", F.pmod(F.xxhash64("a"), F.lit(buckets)).alias("b")).collect():
        hashed[r.a] = r.b
    for r in spark.createDataFrame(list(pairs), "x string, y string").select("x", "y", F.pmod(F.xxhash64(F.xxhash64("x"), F.xxhash64("y")), F.lit(buckets)).alias("b")).collect():
        hashed[r.x, r.y] = r.b
    raw, target, grams = Counter(), Counter(), {}
    for d in docs.collect():
        w = words(d.text)
        g = grams[d.doc_id] = [hashed[x] for x in w] + [hashed[p] for p in zip(w, w[1:], strict=False)]
        raw.update(g)
        if d.doc_id in ids:
            target.update(g)
    share = sum(target.values()) / sum(raw.values())
    ratio = [math.log((target[b] + 2) / (raw[b] * share + 2)) for b in range(buckets)]
    for r in quality.assess(docs, trusted, buckets).collect():
        g = grams[r.doc_id]
        assert r.score == pytest.approx(sum(ratio[b] for b in g) / max(1, len(g)), abs=1e-9)
        assert r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)


def test_clean_documents_stay_and_junk_goes(spark, sf):
    sf = sf.replace("0.001", "0.01")
    out = queries.op8_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("n_words >= 50").toPandas()
    clean = out[(out.quality == 1) & (out.toxic == 0)]
    assert clean.kept.mean() > 0.99 and out[out.quality == 0].kept.mean() < 0.15


def test_quality_filter_on_odd_and_no_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, None), (3, 0, 1)], "doc_id long, quality int, toxic int")
    kept = quality.quality_filter(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 9").count() == 1 and kept.where("doc_id in (4, 5, 6, 7)").count() == 0
    assert quality.quality_filter(no_docs, labels).count() == 0
    assert quality.quality_filter(odd_docs, labels.limit(0)).where("doc_id = 9").count() == 1


def test_language_of_held_out_rows(spark, sf):
    sf = sf.replace("0.001", "0.01")
    out = queries.op6_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and held.score.between(0, 1).all() and out.rejected.mean() < 0.05
    assert 0.2 < out.held_out.mean() < 0.5


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    model = langid.fit(odd_docs)
    got = {r.doc_id: r for r in langid.identify(odd_docs, model).collect()}
    assert got[4].nearest == got[5].nearest == got[6].nearest == "und" and got[5].score == 0
    assert got[9].nearest == "en" and langid.identify(odd_docs, model).count() == odd_docs.count()
    assert langid.fit(no_docs) is None and langid.identify(no_docs, model).count() == 0
    assert {r.nearest for r in langid.identify(odd_docs, None).collect()} == {"und"}
    noise = spark.createDataFrame([(1, "漢字仮名交じり文" * 20)], "doc_id long, text string")
    assert langid.identify(noise, model).first().rejected


def url_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(r), r, v) for v, r in queries.URL_RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_static_rules_match_brute_force(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op9_url_filters(spark, sf).collect():
        host, path, rule, verdict = url_rule(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)


def test_mined_rules_match_brute_force(spark):
    rows = [(f"http://{'bad' if i % 3 == 0 else 'good'}.site{i % 5}.org/{'ads' if i % 2 else 'news'}/{i}", i % 3 == 0 and i % 2 == 1) for i in range(120)] + [(None, True), ("http://x.org/a", None)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    tokens = {r.url: set(r.t) for r in labelled.select("url", urlrules.tokens(F.col("url")).alias("t")).collect()}
    rules = urlrules.mine(labelled, min_support=0.05, min_confidence=0.8)
    usable = {(u, b) for u, b in rows if u and b is not None}
    assert rules.count()
    for r in rules.collect():
        fits = [b for u, b in usable if set(r.antecedent) <= tokens[u]]
        assert r.confidence == pytest.approx(sum(fits) / len(fits)) and r.n == sum(fits)
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)] + [(500, "no scheme"), (None, "HTTP://Bad.Site1.ORG?ads#x"), (501, "http://bad.site9.org/ads/7"), (501, "http://bad.site9.org/ads/7")], "page_id long, url string")
    all_rules = [(set(r.antecedent), r.confidence) for r in rules.collect()]
    for r in urlrules.judge(pages, labelled, [], min_support=0.05, min_confidence=0.8).collect():
        url = dict(pages.collect()).get(r.page_id)
        own = {t.t and tuple(t.t) for t in spark.createDataFrame([(url,)], "url string").select(urlrules.tokens(F.col("url")).alias("t")).collect()} if r.page_id == 501 else None
        best = max((c for a, c in all_rules if a <= (set(*own) if own else tokens.get(url, set()))), default=None)
        assert r.verdict == ("block" if best else "allow") and (best is None or r.confidence == pytest.approx(best))


def test_rules_that_a_shorter_one_covers_go(spark):
    rules = [(["a"], 0.8), (["a", "b"], 0.7), (["b", "c"], 0.7), (["a", "c"], 0.9), (["c"], 0.6)]
    frame = spark.createDataFrame([(a, c, 0.1, 5) for a, c in rules], "antecedent array<string>, confidence double, support double, n long")
    assert sorted(tuple(r.antecedent) for r in urlrules.pruned(frame).collect()) == [("a",), ("a", "c"), ("b", "c"), ("c",)]
    assert "NestedLoop" not in urlrules.pruned(frame)._jdf.queryExecution().executedPlan().toString()


def test_a_very_long_url(spark):
    url = "http://www.example.com/en/" + "/".join(f"p{i}x" for i in range(50_000)) + "?" + "&".join(f"q{i}=1" for i in range(5_000))
    pages = spark.createDataFrame([(1, url), (2, url), (3, "x" * 1_000_000)], "page_id long, url string")
    got = {r.page_id: (len(r.path), r.rule, r.verdict) for r in urlrules.judge(pages, spark.createDataFrame([(url, True)], "url string, blocked boolean"), queries.URL_RULES).collect()}
    path = len(url.split("?")[0]) - len("http://www.example.com")
    assert got == {1: (path, "www.example.com/en/", "allow"), 2: (path, "www.example.com/en/", "allow"), 3: (0, None, "allow")}


def langid_brute(rows, train, model):
    """Predictions from vectors made one n-gram at a time, with the model's weights and centroids."""
    buckets = len(model.idf)

    def vector(text):
        data, out = b" " + text.lower().encode() + b"  ", [0] * buckets
        for i in range(len(data) - 2):
            one, two, three = (data[i + j] + 1 for j in range(3))
            for n, h in ((1, one), (2, one * 0x101 + two), (3, (one * 0x101 + two) * 0x101 + three)):
                h = (h + n) * 0x9E3779B1 & 0xFFFFFFFF
                out[(h ^ h >> 15) & buckets - 1] += 1
        return out

    df = [0] * buckets
    vectors = {i: vector(t) for i, t in enumerate(rows) if langid.has_letter(t)}
    for t in train:
        for b, c in enumerate(vector(t)):
            df[b] += c > 0
    for b in range(0, buckets, 97):
        assert model.idf[b] == pytest.approx(math.log((1 + len(train)) / (1 + df[b])) + 1, rel=1e-5)
    out = []
    for i, _ in enumerate(rows):
        if i not in vectors:
            out.append(("und", 0.0))
            continue
        x = [math.log1p(c) * float(w) for c, w in zip(vectors[i], model.idf, strict=True)]
        norm = math.sqrt(sum(v * v for v in x)) or 1
        cosines = [sum(a * float(b) for a, b in zip(x, c, strict=True) if a) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=lambda j: (round(cosines[j], 6), -j))
        out.append((model.langs[best], cosines[best]))
    return out


def test_languages_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    model = langid.fit(docs, buckets=512)
    train = [r.text for r in docs.collect() if r.text is not None and r.lang is not None and r.doc_id is not None]
    rows = [(r.doc_id, r.nearest, r.score, r.text) for r in langid.identify(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect()]
    for (_, nearest, score, _), (lang, cosine) in zip(rows, langid_brute([r[3] for r in rows], train, model), strict=True):
        assert nearest == lang and score == pytest.approx(max(0, min(1, cosine)), abs=1e-4)


def test_urls_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "url string, blocked boolean")
    pages = spark.createDataFrame([(1, "http://a.net/es/x", "z"), (2, None, None)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in urlrules.judge(pages, none, queries.URL_RULES).collect()}
    assert got == {1: ("a.net", "net/es/", "block"), 2: ("", None, "allow")}
    assert urlrules.judge(pages.limit(0), none, queries.URL_RULES).count() == 0


def test_filter_computes_the_verdict_once(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    judged, kept = plan(quality.assess(docs, quality.trusted_ids(labels))), plan(quality.quality_filter(docs, labels))
    assert kept.count("xxhash64") <= judged.count("xxhash64") and kept.count("split(") <= judged.count("split(")


def test_buckets_grow_with_the_corpus():
    assert [quality.bucket_count(n) for n in (0, 1000, 256_000, 15_000_000, 50_000_000_000)] == [1 << 14, 1 << 14, 1 << 14, 1 << 16, 1 << 20]


def test_an_id_that_repeats_costs_no_language(spark):
    """One id has nearly all rows of one language and all of another."""
    rows = [(1, f"the quick brown fox number {i} and the lazy dog", "en") for i in range(6000)] + [(1, f"der schnelle braune Fuchs {i} und der faule Hund", "de") for i in range(40)]
    rows += [(1, "le renard brun saute", "fr")] * 500
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_sample=300)
    assert set(model.langs) == {"en", "de", "fr"}
    asked = spark.createDataFrame([(1, "der braune Hund und der Fuchs"), (2, "the brown dog and the fox")], "doc_id long, text string")
    assert {r.doc_id: r.nearest for r in langid.identify(asked, model).collect()} == {1: "de", 2: "en"}
