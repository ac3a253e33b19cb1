"""Queries of the retrieval operators over the driver's tables, each with the SQL that states its result.

Cases are the distinct texts of documents under their smallest id; an entry ("knowledge id") is lang:source; queries are the items of
benchmark; an item's gold are the entries of the documents that contain its text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselens.functions.text import stable_rank, tokens
from caselens.operators import dataset, dense, fusion, lexical, metrics
from caselens.operators.containment import contained
from caselens.plans.scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def benchmark(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def cases(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).groupBy("text").agg(F.min("doc_id").alias("docid"))


def entry_of():
    return F.concat_ws(":", "lang", "source")


def links(spark, sf_dir) -> DataFrame:
    """docid, knowledge_id. Texts are known by their hash and never travel; copies are one row for each entry before anything is shuffled."""
    rows = documents(spark, sf_dir).where("text is not null").groupBy(F.sha2("text", 256).alias("h"), entry_of().alias("knowledge_id")).agg(F.min("doc_id").alias("docid"))
    first = F.min("docid").over(Window.partitionBy("h"))
    return Scratch(spark, "links").write(rows.select(first.alias("docid"), "knowledge_id").distinct(), "links")


def gold(spark, sf_dir) -> DataFrame:
    """query_id, gold: the entries of the documents that hold an item of the benchmark."""
    docs = documents(spark, sf_dir)
    held = contained(docs.select("doc_id", "text"), benchmark(spark, sf_dir)).select(F.col("key").alias("doc_id"), F.col("item").alias("query_id"))
    found = docs.select("doc_id", entry_of().alias("knowledge_id")).join(held, "doc_id").select("query_id", "knowledge_id").distinct()
    own = found.groupBy("query_id").agg(F.array_sort(F.collect_list("knowledge_id")).alias("gold"))
    return benchmark(spark, sf_dir).select("query_id").join(own, "query_id", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<string>")))


def titles(spark, sf_dir) -> DataFrame:
    """knowledge_id, label: the distinct texts of an entry, a row for each. An entry's title is all of them, too long for one value."""
    return documents(spark, sf_dir).select(entry_of().alias("knowledge_id"), F.col("text").alias("label")).distinct()


def groups(spark, sf_dir) -> DataFrame:
    """docid, group_id: cases tied by lang, source and the first 24 signs."""
    firsts = documents(spark, sf_dir).groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("docid")).select("docid")
    keys = documents(spark, sf_dir).select(F.col("doc_id").alias("docid"), F.concat_ws("|", "lang", "source", F.substring("text", 1, 24)).alias("k"))
    rows = firsts.join(keys, "docid")
    scratch = Scratch(spark, "groups")
    rows = scratch.write(rows, "rows")
    return rows.join(scratch.write(rows.groupBy("k").agg(F.min("docid").alias("group_id")), "firsts"), "k").select("docid", "group_id")


def case_hits(spark, sf_dir, k: int = 50) -> DataFrame:
    return lexical.bm25(benchmark(spark, sf_dir), lexical.build_index(cases(spark, sf_dir), "docid", "text", Scratch(spark, "cases")), k)


def title_hits(spark, sf_dir, k: int = 10) -> DataFrame:
    index = lexical.build_index(titles(spark, sf_dir), "knowledge_id", "label", Scratch(spark, "titles"), parts=True)
    return lexical.bm25(benchmark(spark, sf_dir), index, k).withColumnRenamed("docid", "knowledge_id")


def votes(spark, sf_dir, hits: DataFrame | None = None) -> DataFrame:
    return fusion.vote(case_hits(spark, sf_dir) if hits is None else hits, links(spark, sf_dir), groups(spark, sf_dir))


# ------------------------------------------------------------------------------------------------------------ queries


def token_stats(spark, sf_dir):
    t = tokens(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def vocab_df(spark, sf_dir):
    return lexical.build_index(cases(spark, sf_dir), "docid", "text", Scratch(spark, "vocabulary")).vocabulary


def bm25_cases_topk(spark, sf_dir):
    return case_hits(spark, sf_dir, 10).select("query_id", "docid", F.round("score", 6).alias("score"), "rank")


def bm25_titles_topk(spark, sf_dir):
    return title_hits(spark, sf_dir).select("query_id", "knowledge_id", F.round("score", 6).alias("score"), "rank")


def case_vote(spark, sf_dir):
    return votes(spark, sf_dir).select("query_id", "knowledge_id", F.round("score", 9).alias("score"), "rank", F.array_join("supporting", ",").alias("supporting"))


def title_case_rrf(spark, sf_dir):
    fused = fusion.rrf({"case": votes(spark, sf_dir), "title": title_hits(spark, sf_dir)}, 10, "knowledge_id")
    return fused.select("query_id", "knowledge_id", F.round("score", 9).alias("score"), "rank", F.coalesce(F.col("route_ranks")["case"], F.lit(0)).alias("case_rank"), F.coalesce(F.col("route_ranks")["title"], F.lit(0)).alias("title_rank"))


def _ranking(voted: DataFrame) -> DataFrame:
    return voted.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "knowledge_id"))), lambda x: x.knowledge_id).alias("ranking"))


def _catalog(spark, sf_dir) -> DataFrame:
    """Entries of the corpus: those of all documents."""
    return documents(spark, sf_dir).select(entry_of().alias("knowledge_id")).distinct()


def recall_metrics(spark, sf_dir):
    ranked = gold(spark, sf_dir).join(_ranking(votes(spark, sf_dir)), "query_id", "left").withColumn("ranking", F.coalesce("ranking", F.array().cast("array<string>")))
    out = metrics.observed_metrics(ranked, _catalog(spark, sf_dir))
    return out.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


def candidate_coverage(spark, sf_dir):
    out = metrics.candidate_coverage(gold(spark, sf_dir), case_hits(spark, sf_dir, 10), links(spark, sf_dir))
    return out.select("queries", F.round("coverage", 9).alias("coverage"))


def stage_attribution(spark, sf_dir):
    hits = case_hits(spark, sf_dir)
    out = metrics.stage_attribution(gold(spark, sf_dir), _catalog(spark, sf_dir), hits, hits.where("rank <= 10"), links(spark, sf_dir), votes(spark, sf_dir, hits))
    return out.groupBy("stage").agg(F.count(F.lit(1)).alias("targets"))


def paired_delta(spark, sf_dir):
    """Title against case votes: recall at 10 over labelled queries."""
    labelled = Scratch(spark, "gold").write(gold(spark, sf_dir), "gold")
    score = lambda hits, name: labelled.where(F.size("gold") > 0).join(_ranking(hits), "query_id", "left").select("query_id", (F.coalesce(F.size(F.array_intersect("gold", "ranking")), F.lit(0)) / F.size("gold")).alias(name))
    pairs = score(title_hits(spark, sf_dir), "one").join(score(votes(spark, sf_dir), "two"), "query_id")
    return metrics.paired_counts(pairs).withColumn("delta", F.round("delta", 9))


def paired_bootstrap(spark, sf_dir):
    pairs = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_no"), F.col("quality").cast("double").alias("one"), (1 - F.col("toxic")).cast("double").alias("two"), F.lit("labels").alias("name"))
    return metrics.bootstrap_frame(pairs, "name")


def _vectors(spark, sf_dir):
    """Queries are the vectors with an id divisible by 50; they search all vectors, themselves too."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.where("vec_id % 50 = 0"), e


def dense_topk(spark, sf_dir):
    queries, every = _vectors(spark, sf_dir)
    return dense.inner_product_topk(queries, every, 10).select("query_id", "docid", F.round("score", 6).alias("score"), "rank")


def dense_filtered_topk(spark, sf_dir):
    queries, every = _vectors(spark, sf_dir)
    allowed = table(spark, sf_dir, "embeddings").where("label % 2 = 0").select("vec_id")
    return dense.inner_product_topk(queries, every, 10, allowed).select("query_id", "docid", F.round("score", 6).alias("score"), "rank")


def _label_links(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("docid"), F.col("label").cast("string").alias("knowledge_id")), e.select(F.col("vec_id").alias("docid"), F.floor(F.col("vec_id") / 3).alias("group_id"))


def dense_vote(spark, sf_dir):
    queries, every = _vectors(spark, sf_dir)
    voted = fusion.vote(dense.inner_product_topk(queries, every, 50), *_label_links(spark, sf_dir), 3)
    return voted.select("query_id", "knowledge_id", F.round("score", 9).alias("score"), "rank")


def hybrid_rrf(spark, sf_dir):
    """The inner-product route with one by L1 distance."""
    queries, every = _vectors(spark, sf_dir)
    one, two = dense.inner_product_topk(queries, every, 50), dense.l1_topk(queries, every, 50)
    fused = fusion.fuse_cases(one.withColumn("source_row", F.col("docid") + 1), two.withColumn("source_row", F.col("docid") + 1), 50)
    return fused.select("query_id", "docid", F.round("score", 9).alias("score"), "rank", F.coalesce(F.col("route_ranks")["bm25"], F.lit(0)).alias("rank_one"), F.coalesce(F.col("route_ranks")["dense"], F.lit(0)).alias("rank_two"))


def judged_metrics(spark, sf_dir):
    hits = case_hits(spark, sf_dir, 10)
    grades = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("docid"), F.least(2 * F.col("quality"), 2 * (1 - F.col("toxic"))).alias("grade"))
    rows = hits.join(grades, "docid").withColumn("mode", F.when(F.col("query_id") % 2 == 0, "problem").otherwise("combined"))
    again = metrics.Window.partitionBy("query_id").orderBy("rank")
    rows = Scratch(spark, "grades").write(rows.withColumn("rank", F.row_number().over(again)), "rows")
    other = rows.withColumn("rank", F.row_number().over(metrics.Window.partitionBy("query_id").orderBy(F.desc("docid"))))
    judged = rows.withColumn("method", F.lit("baseline")).unionByName(other.withColumn("method", F.lit("reranked")))
    per_query = metrics.judged_metrics(judged.select("query_id", "mode", "method", "rank", "grade"), rows.select("query_id", "mode", "grade"))
    out = metrics.summarised(per_query)
    return out.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


def calibration(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(documents(spark, sf_dir).select("doc_id", "n_chars", "lang"), "doc_id")
    scored = rows.select(F.col("lang").alias("mode"), (F.col("doc_id") % 17).alias("query_id"), (F.col("n_chars") % 101).cast("double").alias("score"), (F.col("quality") == 1).alias("relevant"))
    return metrics.calibrate(scored, 0.85).withColumn("precision", F.round("precision", 9))


def dedupe_corpus(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("rid"), F.sha2(F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", ""), 256).alias("text_hash"))
    return dataset.collapse(rows)


def components(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("t"), F.concat_ws("|", "lang", "source", F.substring("text", 1, 24)).alias("k"))
    return dataset.association_groups(rows, ["t", "k"], Scratch(spark, "components"), "doc_id")


def _split_records(spark, sf_dir) -> DataFrame:
    """Records with a call time of 2025-07-01 plus doc_id mod 300 days."""
    day = F.date_add(F.lit("2025-07-01").cast("date"), (F.col("doc_id") % 300).cast("int")).cast("string")
    rows = documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("t"), F.concat_ws("|", "lang", "source", F.substring("text", 1, 24)).alias("k"), dataset.period(F.concat(day, F.lit(" 10:00:00")), "2026-01-01", "2026-02-01").alias("period"))
    scratch = Scratch(spark, "splits")
    return scratch.write(dataset.assign_splits(rows, dataset.association_groups(rows, ["t", "k"], scratch, "doc_id"), "doc_id"), "splits")


def split_assignment(spark, sf_dir):
    return _split_records(spark, sf_dir).select("doc_id", "group_id", "split")


def leakage_audit(spark, sf_dir):
    found = dataset.leakage(_split_records(spark, sf_dir), ["t", "k", "group_id"])
    return found.agg(F.count(F.lit(1)).alias("leaks"))


def stable_sample(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("group_id"))
    return dataset.sample_groups(rows, 50, 42, "doc_id", "doc_id").select("doc_id", stable_rank(42, F.col("doc_id").cast("string")).alias("hash"))


def pilot_strata(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_id"), F.col("doc_id").alias("source_row"), F.col("text").alias("content"), F.col("lang").alias("category"))
    return dataset.select_pilot(rows, 100, 42, strict=False).select("source_id", "category", "length_bucket", "turn")


def catalog_support(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    citations = e.select(F.col("event_id").alias("rid"), F.concat("event_type", F.lit(":"), F.get_json_object("props", "$.k")).alias("knowledge_id"), F.col("event_type").alias("label"))
    records = e.select(F.col("event_id").alias("rid"), F.col("user_id").alias("group_id"), F.lit("corpus").alias("split"))
    return dataset.catalog_support(citations, records)


def corpus_links(spark, sf_dir):
    docs = documents(spark, sf_dir)
    records = docs.select(F.col("doc_id").alias("rid"), F.sha2("text", 256).alias("text_hash"), F.lit("corpus").alias("split"))
    citations = docs.select(F.col("doc_id").alias("rid"), entry_of().alias("knowledge_id"))
    return dataset.corpus_links(dataset.collapse(records), records, citations).groupBy("docid").agg(F.count(F.lit(1)).alias("entries"))


QUERIES = {
    f.__name__: f
    for f in (
        token_stats, vocab_df, bm25_cases_topk, bm25_titles_topk, case_vote, title_case_rrf, recall_metrics, candidate_coverage, stage_attribution, paired_delta, paired_bootstrap,
        dense_topk, dense_filtered_topk, dense_vote, hybrid_rrf, judged_metrics, calibration, dedupe_corpus, components, split_assignment, leakage_audit, stable_sample,
        pilot_strata, catalog_support, corpus_links,
    )
}

# --------------------------------------------------------------------------------------------------------------- SQL

TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"
CASES = "cases AS (SELECT min(doc_id) AS docid, text FROM documents GROUP BY text)"
TITLES = "labels0 AS (SELECT DISTINCT lang || ':' || source AS docid, text AS label FROM documents), cases AS (SELECT docid, string_agg(label, chr(10) ORDER BY label) AS text FROM labels0 GROUP BY docid)"


def _bm25(corpus: str, name: str, k: int) -> str:
    return f"""{corpus}, tl_{name} AS (SELECT docid, {TOK.format('text')} AS t FROM cases), dl_{name} AS (SELECT docid, len(t) AS dl FROM tl_{name}),
        st_{name} AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl_{name}),
        po_{name} AS (SELECT docid, term, count(*) AS tf FROM (SELECT docid, unnest(t) AS term FROM tl_{name}) GROUP BY ALL), vo_{name} AS (SELECT term, count(*) AS df FROM po_{name} GROUP BY term),
        qt_{name} AS (SELECT item_id AS query_id, term, count(*) AS tf FROM (SELECT item_id, unnest({TOK.format('text')}) AS term FROM benchmark) GROUP BY ALL),
        qw_{name} AS (SELECT query_id, term, df, row_number() OVER (PARTITION BY query_id ORDER BY least(tf, 3) / log2(df + 2) DESC, term) AS pos FROM qt_{name} JOIN vo_{name} USING (term)),
        sc_{name} AS (SELECT query_id, docid, -sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
            FROM qw_{name} JOIN po_{name} USING (term) JOIN dl_{name} USING (docid), st_{name} WHERE pos <= 32 GROUP BY ALL),
        {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), docid) AS rank FROM sc_{name}) WHERE rank <= {k})"""


LINKS = "links AS (SELECT DISTINCT docid, lang || ':' || source AS knowledge_id FROM documents JOIN cases USING (text)), refs AS (SELECT docid, count(*) AS refs FROM links GROUP BY docid)"
GROUPS = "gk AS (SELECT docid, d.lang || '|' || d.source || '|' || substring(d.text, 1, 24) AS k FROM cases JOIN documents d ON d.doc_id = docid), groups AS (SELECT docid, min(docid) OVER (PARTITION BY k) AS group_id FROM gk)"


def _vote(hits: str, k: int) -> str:
    return f"""best AS (SELECT query_id, group_id, knowledge_id, max(1 / ((60 + rank) * refs)) AS vote FROM {hits} JOIN links USING (docid) JOIN refs USING (docid) JOIN groups USING (docid) GROUP BY ALL),
        sup AS (SELECT query_id, knowledge_id, string_agg(docid::VARCHAR, ',' ORDER BY rank) AS supporting FROM {hits} JOIN links USING (docid) GROUP BY ALL),
        vs AS (SELECT query_id, knowledge_id, sum(vote) AS score FROM best GROUP BY ALL),
        votes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, knowledge_id) AS rank FROM vs) WHERE rank <= {k})"""


CASE_HITS = _bm25(CASES, "hits", 50)
CASE_VOTES = f"{CASE_HITS}, {LINKS}, {GROUPS}, {_vote('hits', 10)}"
TITLE_HITS = _bm25(TITLES, "thits", 10).replace("cases", "tcases")
GOLD = "gold AS (SELECT DISTINCT item_id AS query_id, lang || ':' || source AS knowledge_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)), known AS (SELECT DISTINCT lang || ':' || source AS knowledge_id FROM documents)"
DOT = "SELECT q.vec_id AS query_id, e.vec_id AS docid, e.label, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: {pair})) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0"
INNER, L1 = "x[1]::DOUBLE * x[2]::DOUBLE", "-abs(x[1]::DOUBLE - x[2]::DOUBLE)"


def _dense(name: str, k: int, where: str = "true", pair: str = INNER) -> str:
    return f"d_{name} AS ({DOT.format(pair=pair)} AND {where}), {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, docid) AS rank FROM d_{name}) WHERE rank <= {k})"


EDGE_KEYS = "keyed AS (SELECT doc_id, sha256(text) AS t, lang || '|' || source || '|' || substring(text, 1, 24) AS k FROM documents)"
COMPONENTS = f"""{EDGE_KEYS}, edges AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM keyed a JOIN keyed b ON a.t = b.t OR a.k = b.k),
    reach AS (SELECT doc_id AS node, doc_id AS label FROM keyed UNION SELECT e.b, r.label FROM reach r JOIN edges e ON e.a = r.node WHERE r.label < e.b),
    comp AS (SELECT node AS doc_id, min(label) AS group_id FROM reach GROUP BY node)"""
RECALL = ", ".join(
    f"round(avg((SELECT count(*) FROM gold g JOIN votes v USING (query_id, knowledge_id) WHERE g.query_id = q.query_id AND rank <= {k}) / n), 9) AS observed_recall_{k}, "
    f"round(avg(CASE WHEN (SELECT count(*) FROM gold g JOIN votes v USING (query_id, knowledge_id) WHERE g.query_id = q.query_id AND rank <= {k}) > 0 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS observed_hit_{k}, "
    f"round(avg(CASE WHEN nk > 0 THEN (SELECT count(*) FROM gold g JOIN known USING (knowledge_id) JOIN votes v USING (query_id, knowledge_id) WHERE g.query_id = q.query_id AND rank <= {k}) / nk END), 9) AS known_target_recall_{k}"
    for k in (1, 5, 10)
)

SQL = {
    "token_stats": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {TOK.format('text')} AS t FROM documents)",
    "vocab_df": f"WITH {CASES}, po AS (SELECT docid, term, count(*) AS tf FROM (SELECT docid, unnest({TOK.format('text')}) AS term FROM cases) GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM po GROUP BY term",
    "bm25_cases_topk": f"WITH {_bm25(CASES, 'hits', 10)} SELECT query_id, docid, round(score, 6) AS score, rank FROM hits",
    "bm25_titles_topk": f"WITH {TITLE_HITS} SELECT query_id, docid AS knowledge_id, round(score, 6) AS score, rank FROM thits",
    "case_vote": f"WITH {CASE_VOTES} SELECT query_id, knowledge_id, round(score, 9) AS score, rank, supporting FROM votes JOIN sup USING (query_id, knowledge_id)",
    "title_case_rrf": f"""WITH {CASE_VOTES}, {TITLE_HITS},
        f AS (SELECT query_id, knowledge_id, sum(1 / (60 + rank)) AS score, max(CASE WHEN route = 'case' THEN rank ELSE 0 END) AS case_rank, max(CASE WHEN route = 'title' THEN rank ELSE 0 END) AS title_rank
            FROM (SELECT query_id, knowledge_id, rank, 'case' AS route FROM votes UNION ALL SELECT query_id, docid, rank, 'title' FROM thits) GROUP BY query_id, knowledge_id)
        SELECT * FROM (SELECT query_id, knowledge_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, knowledge_id) AS rank, case_rank, title_rank FROM f) WHERE rank <= 10""",
    "recall_metrics": f"""WITH {CASE_VOTES}, {GOLD}, q AS (SELECT query_id, count(*) AS n, count(k.knowledge_id) AS nk FROM gold LEFT JOIN known k USING (knowledge_id) GROUP BY query_id)
        SELECT count(*) AS labeled_queries, (SELECT count(*) FROM benchmark) - count(*) AS unlabeled_queries, count_if(nk > 0)::BIGINT AS known_target_queries, sum(nk) / sum(n) AS target_catalog_coverage_, avg(nk / n) AS catalog_recall_ceiling_, {RECALL} FROM q""",
    "candidate_coverage": f"""WITH {_bm25(CASES, 'hits', 10)}, {LINKS}, {GOLD}, q AS (SELECT query_id, count(*) AS n FROM gold GROUP BY query_id),
        c AS (SELECT DISTINCT query_id, knowledge_id FROM hits JOIN links USING (docid)), g AS (SELECT query_id, count(*) AS m FROM gold JOIN c USING (query_id, knowledge_id) GROUP BY query_id)
        SELECT count(*) AS queries, round(avg(coalesce(m, 0) / n), 9) AS coverage FROM q LEFT JOIN g USING (query_id)""",
    "stage_attribution": f"""WITH {CASE_VOTES}, {GOLD}, u AS (SELECT DISTINCT query_id, knowledge_id FROM hits JOIN links USING (docid)), f AS (SELECT DISTINCT query_id, knowledge_id FROM hits JOIN links USING (docid) WHERE rank <= 10)
        SELECT CASE WHEN k.knowledge_id IS NULL THEN 'outside_catalog' WHEN u.query_id IS NULL THEN 'missed_in_union' WHEN f.query_id IS NULL THEN 'lost_in_fusion_cutoff' WHEN v.query_id IS NULL THEN 'lost_in_voting' ELSE 'top10_hit' END AS stage, count(*) AS targets
        FROM gold g LEFT JOIN known k USING (knowledge_id) LEFT JOIN u USING (query_id, knowledge_id) LEFT JOIN f USING (query_id, knowledge_id) LEFT JOIN votes v USING (query_id, knowledge_id) GROUP BY 1""",
    "paired_delta": f"""WITH {CASE_VOTES}, {TITLE_HITS}, {GOLD}, q AS (SELECT query_id, count(*) AS n FROM gold GROUP BY query_id),
        s AS (SELECT query_id, (SELECT count(*) FROM gold g JOIN thits t ON t.query_id = g.query_id AND t.docid = g.knowledge_id WHERE g.query_id = q.query_id) / n AS one,
                     (SELECT count(*) FROM gold g JOIN votes v USING (query_id, knowledge_id) WHERE g.query_id = q.query_id) / n AS two FROM q)
        SELECT count(*) AS n, round(avg(two - one), 9) AS delta, count_if(two > one)::BIGINT AS wins, count_if(two < one)::BIGINT AS losses, count_if(two = one)::BIGINT AS ties FROM s""",
    "dense_topk": f"WITH {_dense('hits', 10)} SELECT query_id, docid, round(score, 6) AS score, rank FROM hits",
    "dense_filtered_topk": f"WITH {_dense('hits', 10, 'e.label % 2 = 0')} SELECT query_id, docid, round(score, 6) AS score, rank FROM hits",
    "dense_vote": f"""WITH {_dense('hits', 50)}, links AS (SELECT vec_id AS docid, label::VARCHAR AS knowledge_id FROM embeddings), refs AS (SELECT docid, 1 AS refs FROM links), groups AS (SELECT vec_id AS docid, vec_id // 3 AS group_id FROM embeddings),
        {_vote('(SELECT query_id, docid, rank FROM hits)', 3)} SELECT query_id, knowledge_id, round(score, 9) AS score, rank FROM votes""",
    "hybrid_rrf": f"""WITH {_dense('one', 50)}, {_dense('two', 50, pair=L1)}, f AS (SELECT query_id, docid, sum(1 / (60 + rank)) AS score, max(CASE WHEN r = 1 THEN rank ELSE 0 END) AS rank_one, max(CASE WHEN r = 2 THEN rank ELSE 0 END) AS rank_two
            FROM (SELECT query_id, docid, rank, 1 AS r FROM one UNION ALL SELECT query_id, docid, rank, 2 FROM two) GROUP BY ALL)
        SELECT * FROM (SELECT query_id, docid, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, docid) AS rank, rank_one, rank_two FROM f) WHERE rank <= 50""",
    "dedupe_corpus": r"SELECT sha256(regexp_replace(text, '[ \t\n\x0B\f\r]+', '', 'g')) AS text_hash, min(doc_id) AS rid FROM documents GROUP BY 1",
    "components": f"WITH RECURSIVE {COMPONENTS} SELECT doc_id, group_id FROM comp",
    "split_assignment": f"""WITH RECURSIVE {COMPONENTS}, p AS (SELECT doc_id, CASE WHEN DATE '2025-07-01' + (doc_id % 300)::INT < DATE '2026-01-01' THEN 1 WHEN DATE '2025-07-01' + (doc_id % 300)::INT < DATE '2026-02-01' THEN 2 ELSE 4 END AS period FROM documents),
        m AS (SELECT group_id, bit_or(period) AS mask FROM comp JOIN p USING (doc_id) GROUP BY group_id)
        SELECT doc_id, group_id, CASE mask WHEN 1 THEN 'corpus' WHEN 2 THEN 'dev' WHEN 4 THEN 'test' ELSE 'cross_period' END AS split FROM comp JOIN m USING (group_id)""",
    "leakage_audit": "",
    "stable_sample": "SELECT doc_id, sha256('42:' || doc_id) AS hash FROM (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text) ORDER BY hash, doc_id LIMIT 50",
    "pilot_strata": """WITH f AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE trim(text, E' \\t\\n\\r') <> '' AND NOT contains(text, chr(9)) GROUP BY text), s AS (SELECT f.doc_id, d.lang AS category, f.text,
            CASE WHEN length(f.text) <= 50 THEN '01_le_50' WHEN length(f.text) <= 200 THEN '02_51_200' WHEN length(f.text) <= 500 THEN '03_201_500' WHEN length(f.text) <= 2000 THEN '04_501_2000' ELSE '05_gt_2000' END AS length_bucket FROM f JOIN documents d USING (doc_id)),
        r AS (SELECT doc_id::VARCHAR AS source_id, category, length_bucket, row_number() OVER (PARTITION BY category, length_bucket ORDER BY sha256(encode('42') || '\\x00'::BLOB || encode(doc_id::VARCHAR) || '\\x00'::BLOB || encode(sha256(text))), doc_id) AS turn FROM s)
        SELECT * FROM r WHERE turn <= 32 ORDER BY turn, category, length_bucket LIMIT 100""",
    "catalog_support": "SELECT event_type || ':' || json_extract_string(props, '$.k') AS knowledge_id, event_type AS label, count(DISTINCT user_id) AS support FROM events GROUP BY 1, 2",
    "corpus_links": f"WITH {CASES}, {LINKS} SELECT docid, count(*) AS entries FROM links GROUP BY docid",
    "calibration": """WITH s AS (SELECT lang AS mode, doc_id % 17 AS query_id, n_chars % 101 AS score, quality = 1 AS relevant FROM labels JOIN documents USING (doc_id)),
        t AS (SELECT DISTINCT mode, score AS threshold FROM s), a AS (SELECT t.mode, threshold, count(*) AS results, count(DISTINCT query_id) AS queries, count_if(relevant) AS hits FROM t JOIN s ON s.mode = t.mode AND s.score >= threshold GROUP BY ALL)
        SELECT mode, threshold::DOUBLE AS threshold, results, queries, round(hits / results, 9) AS precision FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY results DESC, threshold) AS r FROM a WHERE results >= 5 AND queries >= 3 AND hits >= 0.85 * results) WHERE r = 1""",
    "judged_metrics": f"""WITH {_bm25(CASES, 'hits', 10)}, g AS (SELECT doc_id AS docid, least(2 * quality, 2 * (1 - toxic)) AS grade FROM labels),
        r0 AS (SELECT query_id, docid, grade, CASE WHEN query_id % 2 = 0 THEN 'problem' ELSE 'combined' END AS mode, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r1, row_number() OVER (PARTITION BY query_id ORDER BY docid DESC) AS r2, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS ri FROM hits JOIN g USING (docid)),
        i AS (SELECT query_id, sum(CASE WHEN ri <= 5 THEN (pow(2, grade) - 1) / log2(ri + 1) ELSE 0 END) AS ideal FROM r0 GROUP BY query_id),
        j AS (SELECT query_id, mode, 'baseline' AS method, r1 AS rank, grade FROM r0 UNION ALL SELECT query_id, mode, 'reranked', r2, grade FROM r0),
        p AS (SELECT query_id, mode, method, count_if(rank <= 5) AS returned, count_if(rank <= 5 AND grade >= 2) AS rel, sum(CASE WHEN rank <= 5 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg FROM j GROUP BY ALL),
        n AS (SELECT p.*, rel / 5 AS prec, CASE WHEN ideal <> 0 THEN dcg / ideal END AS ndcg FROM p JOIN i USING (query_id))
        SELECT coalesce(mode, 'all') AS mode, method, count(*) AS queries, round(avg(prec), 9) AS mean_precision, round(avg(ndcg), 9) AS mean_ndcg, count(ndcg) AS ndcg_queries, round(sum(rel) / sum(returned), 9) AS returned_precision,
               round(avg(CASE WHEN returned > 0 THEN 1 ELSE 0 END), 9) AS query_coverage, round(avg(returned), 9) AS mean_returned FROM n GROUP BY GROUPING SETS ((mode, method), (method))""",
}
SQL["recall_metrics"] = SQL["recall_metrics"].replace("sum(nk) / sum(n) AS target_catalog_coverage_", "round(sum(nk) / sum(n), 9) AS target_catalog_coverage").replace("avg(nk / n) AS catalog_recall_ceiling_", "round(avg(nk / n), 9) AS catalog_recall_ceiling")
SQL["leakage_audit"] = f"""{SQL['split_assignment'][: SQL['split_assignment'].index('SELECT doc_id, group_id, CASE mask')].rstrip()}, s AS ({SQL['split_assignment'][SQL['split_assignment'].index('SELECT doc_id, group_id, CASE mask') :]}),
    x AS (SELECT 't' AS key, t AS value, split FROM s JOIN keyed USING (doc_id) UNION ALL SELECT 'k', k, split FROM s JOIN keyed USING (doc_id) UNION ALL SELECT 'group_id', group_id::VARCHAR, split FROM s),
    l AS (SELECT key, value FROM x WHERE value <> '' GROUP BY 1, 2 HAVING count(DISTINCT split) > 1) SELECT count(*) AS leaks FROM l"""
