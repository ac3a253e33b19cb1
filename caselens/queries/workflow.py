"""Queries of the address, search, extraction, scoring, judging, annotation, source and streaming operators over the driver's tables,
each with the SQL that states its result. Inputs that the tables do not hold (addresses, quotes, judgments, files) are made of their rows
by rules that the SQL repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.functions import text as T
from caselens.functions.address import parsed_address
from caselens.functions.evidence import EvidenceError, align
from caselens.operators import address, annotation, dataset, dense, extraction, judging, lexical, metrics, profile, scoring
from caselens.plans import evaluation, report
from caselens.plans.scratch import Scratch
from caselens.plans.search import Searcher
from caselens.queries.profiling import SQL as PROFILING_SQL, _columns
from caselens.queries.retrieval import CASES, COMPONENTS, LINKS, SQL as RETRIEVAL_SQL, _bm25, _dense, _vote, benchmark, case_hits, cases, documents, links, table
from caselens.sources import files
from caselens.streaming import incremental

# ------------------------------------------------------------------------------------------------------- texts

ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.,"
WIDE = "".join(chr(ord(c) + 0xFEE0) for c in ASCII)
LATIN = "abcdefghijklmnopqrstuvwxyz"
CJK = "".join(chr(0x4E00 + 3 * i) for i in range(26))


def content_keys(spark, sf_dir):
    """Texts in full-width signs have the keys of the plain ones."""
    return documents(spark, sf_dir).select("doc_id", T.content_key(F.translate("text", ASCII, WIDE)).alias("key"), T.content_key(F.col("text")).alias("plain_key"))


def cjk_tokens(spark, sf_dir):
    """Tokens of texts whose letters were turned into CJK signs, with a placeholder and a Latin word behind."""
    made = F.concat(F.translate(F.lower("text"), LATIN, CJK), F.lit(" [phone] ab12"))
    t = T.tokens(made)
    return documents(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens"))


def _written_times(spark, sf_dir) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    shapes = [
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+08:00")),
        F.date_format(ts, "yyyyMMdd'T'HHmmss"), F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "'on 'yyyy-MM-dd"), F.lit(" NULL "), F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("-0330")),
    ]
    raw = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        raw = F.when(F.col("event_id") % len(shapes) == i, shape).otherwise(raw)
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))


def iso_times(spark, sf_dir):
    return _written_times(spark, sf_dir).select("event_id", F.date_format(T.iso_time(F.col("raw")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time"))


def raw_date_profile(spark, sf_dir):
    out = profile.date_profile(_written_times(spark, sf_dir), "raw")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return out.select("total", "filled", "valid", "invalid", shown("first"), shown("last"))


def annotation_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", T.annotation_id(F.col("conv_id").cast("string"), F.concat("role", F.lit('"'), F.col("turn").cast("string"))).alias("annotation_id"))


def unit_vectors(spark, sf_dir):
    """Vectors at unit length: their first and last value, and their norm."""
    v = T.unit_vector(F.col("embedding"), 64)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return rows.select("vec_id", F.round(F.get("v", F.lit(0)).cast("double"), 5).alias("first"), F.round(F.get("v", F.lit(63)).cast("double"), 5).alias("last"), F.round(norm, 4).alias("norm"))


def distinct_within(spark, sf_dir):
    """Exact counts of safe columns; of the others whether the sketch is within 5 % of the truth."""
    docs = documents(spark, sf_dir)
    found = profile.distinct_counts(docs, ["lang", "source"], ["text", "n_chars"])
    true = docs.agg(*[F.countDistinct(c).alias(c) for c in ("lang", "source", "text", "n_chars")], F.countDistinct("text", "n_chars", "lang", "source").alias("<row>"))
    true = true.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in true.columns]), F.array(*[F.col(f"`{c}`") for c in true.columns]))).alias("field", "true"))
    exact = F.col("method") == "exact"
    return found.join(true, "field").select("field", "method", F.when(exact, F.col("distinct_values")).alias("exact_values"), (F.abs(F.col("distinct_values") - F.col("true")) <= 0.05 * F.col("true")).alias("within"))


def pii_types(spark, sf_dir):
    """Texts by kind of personal data; every seventh text gets a mobile number, every eleventh a citizen id."""
    made = F.concat("text", F.when(F.col("doc_id") % 7 == 0, F.lit(" 13812345678 ")).otherwise(F.lit("")), F.when(F.col("doc_id") % 11 == 0, F.lit(" 11010519491231002X.")).otherwise(F.lit("")))
    return profile.pii_counts(documents(spark, sf_dir).select(made.alias("text"), "source"), ["text", "source"])


def dictionary(spark, sf_dir):
    """Column statistics beside a catalogue that knows two of the columns."""
    rows = profile.column_profile(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment", "c_nationkey"]).select("field", "total", "filled", "max_length")
    known = spark.createDataFrame([("c_name", "name", "text"), ("c_nationkey", "nation", None)], "field string, meaning string, kind string")
    return profile.field_dictionary(rows, known)


def report_lines(spark, sf_dir):
    """A Markdown table of the market segments, line by line."""
    top = [r.asDict() for r in profile.top_values(table(spark, sf_dir, "customer"), "c_mktsegment", 5).collect()]
    total = sum(r["count"] for r in top)
    lines = files.markdown_table([{**r, "value": f"{r['value']}|x", "share_rate": r["count"] / total} for r in top], {"value": "Segment", "count": "Rows", "share_rate": "Share"}).splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


# --------------------------------------------------------------------------------------------------- addresses

PLACES, DISTRICTS, ROADS = ["幸福小区", "平安花园", "阳光公寓", "世纪广场"], ["武进区", "钟楼区", "天宁区"], ["劳动东路", "中山北路"]


def _pick(values: list[str], n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))


def _addressed(spark, sf_dir) -> DataFrame:
    """docid, source_id, source_row, content, call_time: customers with an address each, every second one in full-width digits."""
    k = F.col("c_custkey")
    number = (k % 7 + 1).cast("string")
    number = F.when(k % 2 == 0, F.translate(number, "1234567", "１２３４５６７")).otherwise(number)
    place = F.concat(F.lit("市民反映位于"), _pick(DISTRICTS, k % 3), _pick(PLACES, k % 4), number, F.lit("号楼有噪音"))
    road = F.concat(_pick(ROADS, k % 2), (k % 11 + 1).cast("string"), F.lit("号门口积水"))
    content = F.when(k % 5 < 3, place).when(k % 5 == 3, road).otherwise(F.lit("附近小区很吵"))
    return table(spark, sf_dir, "customer").select(k.alias("docid"), F.format_string("old-%09d", k).alias("source_id"), k.alias("source_row"), content.alias("content"), F.lit("2025-08-01 10:00:00").alias("call_time"))


ADDRESS_QUERIES = [(1, "幸福小区3号楼"), (2, "武进区平安花园"), (3, "劳动东路4号"), (4, "劳动东路"), (5, "世纪广场9号楼")]


def address_index(spark, sf_dir):
    return address.build_address_index(_addressed(spark, sf_dir)).select("docid", "kind", "normalized", "text", "start", "end", "address_group")


def address_parts(spark, sf_dir):
    """How many mentions each text has, tied or not."""
    rows = _addressed(spark, sf_dir).select("docid", parsed_address(F.col("content")).alias("e"))
    return rows.select("docid", F.size("e").alias("mentions"), F.array_join(F.transform("e", lambda x: x.kind), ",").alias("kinds"))


def address_search(spark, sf_dir):
    cases_ = _addressed(spark, sf_dir)
    required = address.required_frame(spark, ADDRESS_QUERIES)
    found = address.search_addresses(required, address.build_address_index(cases_), cases_, 1 << 30, allow_broader=True)
    return found.select("query_id", "docid", "rank", "scope", "broader", F.array_join(F.transform("evidence", lambda e: F.concat(e.kind, F.lit("="), e.text)), " ").alias("evidence"))


def _lettered(spark, sf_dir) -> DataFrame:
    """Cases of documents under an address of their own: content holds the address, the index the text."""
    k = F.col("docid")
    content = F.concat(F.lit("位于"), _pick(PLACES, k % 4), (k % 3 + 1).cast("string"), F.lit("号楼"))
    return cases(spark, sf_dir).select("docid", F.format_string("old-%09d", k).alias("source_id"), k.alias("source_row"), content.alias("content"), F.lit("2025-08-01 10:00:00").alias("call_time"), "text")


def combined_search(spark, sf_dir):
    """The first item of the benchmark among the cases of one building: the pool comes before the cut."""
    rows = _lettered(spark, sf_dir)
    index = lexical.build_index(rows, "docid", "text", Scratch(spark, "combined"))
    found = Searcher(rows.drop("text"), index, addresses=address.build_address_index(rows)).search(
        benchmark(spark, sf_dir).orderBy("query_id").first()["query"], "combined", "bm25", "幸福小区2号楼", top_k=10, case_k=20
    )
    return found.select("source_id", "source_row", "rank", F.col("address.scope").alias("scope"), F.col("route_ranks")["bm25"].alias("bm25_rank"))


def problem_search(spark, sf_dir):
    """The first item of the benchmark among all cases, with the words that query and case share."""
    rows = cases(spark, sf_dir)
    rows = rows.select("docid", F.format_string("old-%09d", "docid").alias("source_id"), F.col("docid").alias("source_row"), F.col("text").alias("content"), F.lit("x").alias("call_time"))
    index = lexical.build_index(rows, "docid", "content", Scratch(spark, "problem"))
    found = Searcher(rows, index).search(benchmark(spark, sf_dir).orderBy("query_id").first()["query"], "problem", "bm25", top_k=10)
    return found.select("source_id", "rank", F.array_join("shared_keywords", " ").alias("shared"))


def bm25_pool(spark, sf_dir):
    """The ten best cases among those of even id, for each item of the benchmark."""
    index = lexical.build_index(cases(spark, sf_dir), "docid", "text", Scratch(spark, "pool"))
    filed = cases(spark, sf_dir).select("docid", (F.col("docid") % 4).alias("area"))
    areas = benchmark(spark, sf_dir).select("query_id", (F.col("query_id") % 2 * 2).alias("area"))
    hits = lexical.bm25(benchmark(spark, sf_dir), index, 10, allowed=areas, filed=filed)
    return hits.select("query_id", "docid", F.round("score", 6).alias("score"), "rank")


# ------------------------------------------------------------------------------------- reranking and judgments


def _reranked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark, "reranked")
    hits = case_hits(spark, sf_dir, 10).join(benchmark(spark, sf_dir), "query_id").join(cases(spark, sf_dir).withColumnRenamed("text", "content"), "docid")
    hits = scratch.write(hits.select("query_id", "query", "docid", "content", "rank"), "hits")
    return hits, scratch.write(judging.rerank(hits, judging.OverlapReranker), "reranked")


def rerank_topk(spark, sf_dir):
    hits, out = _reranked(spark, sf_dir)
    judging.validate_runs(hits.select("query_id", "docid", "rank"), out)
    return out.select("query_id", "docid", F.round("rerank_score", 9).alias("score"), "retrieval_rank", "rank")


def rerank_selection(spark, sf_dir):
    _, out = _reranked(spark, sf_dir)
    _, status = judging.select_results(out, benchmark(spark, sf_dir), 5, 0.4)
    return status


def judgment_pool(spark, sf_dir):
    hits, out = _reranked(spark, sf_dir)
    return judging.judgment_pool(hits, out, 5)


def judgment_sheet(spark, sf_dir):
    """The sheet of a pool, written as TSV, read again and checked against what was handed out."""
    hits, out = _reranked(spark, sf_dir)
    asked = hits.select("query_id", F.lit("problem").alias("mode"), F.concat(F.lit("="), "query").alias("query"), F.lit(None).cast("string").alias("address")).distinct()
    sheet = judging.worksheet(judging.judgment_pool(hits, out, 3), asked, hits.select("docid", F.col("content").alias("case_content")).distinct())
    path = Scratch(spark, "sheet").path("sheet")
    files.write_tsv(sheet, path)
    back = judging.read_judgments(files.read_tsv(spark, path, set(judging.WORKSHEET)).withColumn("problem_grade", F.lit(" 2 ")), sheet)
    return back.select("annotation_id", "query_id", F.substring("query", 1, 2).alias("guard"), F.length("case_content").alias("content_length"), "problem_grade", F.coalesce("address_grade", F.lit(-1)).alias("address_grade"))


def latency_p95(spark, sf_dir):
    return metrics.p95(table(spark, sf_dir, "events"), "value")


def combined_grades(spark, sf_dir):
    mode = F.when(F.col("doc_id") % 3 == 0, "combined").when(F.col("doc_id") % 3 == 1, "address").otherwise("problem")
    rows = table(spark, sf_dir, "labels").select("doc_id", mode.alias("mode"), (2 * F.col("quality")).alias("p"), (2 - 2 * F.col("toxic")).alias("a"))
    return rows.select("doc_id", "mode", metrics.combined_grade(F.col("p"), F.col("a"), F.col("mode")).alias("grade"))


def sliced_recall(spark, sf_dir):
    """Events as queries: their user's kinds of event are the gold, the kinds in order of name the ranking, slices by hour of day."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.hour(F.col("ts").cast("timestamp_ntz")).alias("hour"))
    gold = e.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    every = e.select("event_type").distinct().agg(F.array_sort(F.collect_list("event_type")).alias("ranking"))
    ranked = e.join(gold, "user_id").crossJoin(F.broadcast(every)).select(F.col("event_id").alias("query_id"), F.when(F.col("event_id") % 5 > 0, F.col("kinds")).otherwise(F.array().cast("array<string>")).alias("gold"), "ranking", "hour")
    out = metrics.observed_metrics(ranked, e.where("event_type <> 'error'").select(F.col("event_type").alias("knowledge_id")), "hour")
    return out.select("hour", "labeled_queries", "unlabeled_queries", "known_target_queries", *[F.round(c, 9).alias(c) for c in ("target_catalog_coverage", "catalog_recall_ceiling", "observed_recall_1", "observed_hit_1", "known_target_recall_1", "observed_recall_5")])


# --------------------------------------------------------------------------------------------------- extraction

CONTRACT = extraction.Contract("leading-words", segment_chars=1 << 30)


def _awake(seconds: float) -> None:
    """Stands for waiting where nothing is worth waiting for."""


def _records(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_id"), F.col("doc_id").alias("source_row"), F.col("text").alias("case_content"))


def _extracted(spark, sf_dir, **options) -> DataFrame:
    """Calls of the stand-in need no bound, so a task does not grow with the input."""
    out = extraction.run_extraction(_records(spark, sf_dir), extraction.LeadingWords, CONTRACT, partitions=None, sleep=_awake, **options)
    return Scratch(spark, "extracted").write(out.drop("case_content"), "results")


def extraction_spans(spark, sf_dir):
    """Where the quotes of each text stand; texts that the model refused have an error."""
    rows = _extracted(spark, sf_dir).withColumn("e", F.get(F.from_json("events", annotation.EVENTS), F.lit(0)))
    return rows.select(
        F.col("source_row").alias("doc_id"), F.col("e.trigger.start").alias("trigger_start"), F.col("e.trigger.end").alias("trigger_end"), F.get("e.behaviors", F.lit(0))["start"].alias("behavior_start"),
        F.size("e.requests").alias("requests"), "attempts", F.coalesce("error_code", F.lit("")).alias("error"),
    )


def extraction_views(spark, sf_dir):
    rows = extraction.accepted(_extracted(spark, sf_dir))
    return rows.select(F.col("source_row").alias("doc_id"), F.col("views")["evidence_core"].alias("evidence_core"), F.col("views")["semantic_terms"].alias("semantic_terms"))


def extraction_audit(spark, sf_dir):
    out = extraction.audit(_extracted(spark, sf_dir))
    return out.withColumn("exact_evidence_quote_rate", F.round("exact_evidence_quote_rate", 9))


def extraction_errors(spark, sf_dir):
    out = _extracted(spark, sf_dir)
    return extraction.histograms(out).unionByName(extraction.quarantined(out).groupBy(F.lit("quarantined").alias("what"), F.col("error_type").alias("value")).agg(F.count(F.lit(1)).alias("count")))


def extraction_resumed(spark, sf_dir):
    """A second run: a third of the records is done, another third lies in the cache of the first run."""
    every, scratch = _extracted(spark, sf_dir), Scratch(spark, "cache")
    part = lambda i: every.where(F.col("source_row") % 3 == i)
    cache = scratch.write(extraction.cache_rows(part(1)), "cache")
    scratch.release()
    again = _extracted(spark, sf_dir, cache=cache, done=part(0))
    scratch.drop("cache")
    return again.select(F.col("source_row").alias("doc_id"), "attempts")


def extraction_segments(spark, sf_dir):
    """Texts in segments of a thousand signs: the events of all segments of a text are one, at their places in the whole text."""
    out = extraction.run_extraction(_records(spark, sf_dir), extraction.LeadingWords, extraction.Contract("leading-words", segment_chars=1000), partitions=None, sleep=_awake)
    rows = out.withColumn("e", F.get(F.from_json("events", annotation.EVENTS), F.lit(0)))
    return rows.select(F.col("source_row").alias("doc_id"), F.col("e.trigger.start").alias("trigger_start"), F.array_join(F.transform("e.behaviors", lambda b: b.start.cast("string")), " ").alias("behavior_starts"), F.coalesce("error_code", F.lit("")).alias("error"))


def seed_queries(spark, sf_dir):
    """A query set of the nations as problems and their regions as addresses, checked."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect()
    return judging.validate_queries(judging.seed_queries(spark, [(r["n_name"], f"{r['r_name']} {r['n_nationkey']}") for r in rows]))


def encoded_shards(spark, sf_dir):
    """Documents that arrive in files, encoded in micro-batches; a second call finds nothing new."""
    scratch = Scratch(spark, "encoded")
    docs = scratch.write(documents(spark, sf_dir).select(F.col("doc_id").alias("docid"), "text").repartition(8, "docid"), "in")
    for _ in range(2):
        incremental.encode_new(spark, scratch.path("in"), docs.schema, scratch.path("state"), scratch.path("out"), dense.HashEncoder(16))
    shards = spark.read.parquet(scratch.path("out"))
    dense.validate_shards(shards, 16)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return shards.select(F.col("docid").alias("doc_id"), F.size("embedding").alias("dimension"), F.round(norm, 4).alias("norm"))


def records_to_do(spark, sf_dir):
    rows = _records(spark, sf_dir)
    return incremental.resumed(rows, rows.where("source_row % 3 = 0"), "source_id", "case_content").select(F.col("source_row").alias("doc_id"))


def _aligned(text, quote, start):
    try:
        span, repaired = align({"text": quote, "start": start, "end": start + len(quote)}, text)
    except EvidenceError as e:
        return {"start": None, "repaired": None, "error": e.code}
    return {"start": span["start"], "repaired": repaired, "error": None}


def span_alignment(spark, sf_dir):
    """The second word of each text, proposed up to four signs beside its place."""
    udf = F.udf(_aligned, "struct<start:int,repaired:boolean,error:string>", useArrow=True)
    rows = documents(spark, sf_dir).select("doc_id", "text", F.get(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != ""), F.lit(1)).alias("quote")).where("quote is not null")
    rows = rows.select("doc_id", udf("text", "quote", F.expr("locate(quote, text) - 1 + doc_id % 5").cast("int")).alias("a"))
    return rows.select("doc_id", "a.start", "a.repaired", "a.error")


# ------------------------------------------------------------------------------------------ gold and adjudication


def _issues():
    word = F.array(F.get(F.split(F.trim("case_content"), " "), F.lit(0)))
    one = F.struct(F.lit("active").alias("scope"), F.lit("i1").alias("issue_id"), (F.col("source_row") % 2 == 0).alias("is_current_request"), F.lit("occurred").alias("expected_polarity"), word.alias("evidence_quotes"))
    two = F.struct(F.lit("active").alias("scope"), F.lit("i2").alias("issue_id"), F.lit(False).alias("is_current_request"), F.lit("possible").alias("expected_polarity"), F.concat(word, word).alias("evidence_quotes"))
    back = F.struct(F.lit("background").alias("scope"), F.lit("b1").alias("issue_id"), F.lit(False).alias("is_current_request"), F.lit(None).cast("string").alias("expected_polarity"), F.array().cast("array<string>").alias("evidence_quotes"))
    none = F.array().cast("array<struct<scope:string,issue_id:string,is_current_request:boolean,expected_polarity:string,evidence_quotes:array<string>>>")
    return F.concat(F.array(one), F.when(F.col("source_row") % 3 == 0, F.array(two)).otherwise(none), F.when(F.col("source_row") % 5 == 0, F.array(back)).otherwise(none))


def _gold(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(gold frozen from finished sheets, records)."""
    records = _records(spark, sf_dir)
    sheet = annotation.gold_worksheet(records, 1 << 30)
    status = F.when(F.col("source_row") % 4 == 0, "resolved").otherwise("open")
    return annotation.frozen_gold(sheet.withColumns({"review_status": F.lit("complete"), "annotator_id": F.lit(" me "), "case_status": status, "issues": _issues()}), records), records


def issue_scores(spark, sf_dir):
    """Totals over predictions with doc_id mod 4 events: the first matches i1, the second the background issue if there is one, the third
    is spurious, and there is no fourth."""
    gold, records = _gold(spark, sf_dir)
    gold = Scratch(spark, "gold").write(gold, "gold")
    n = (F.col("source_row") % 4).cast("int")
    has_back = F.col("source_row") % 5 == 0
    quote = F.get("issues", F.lit(0))["evidence_quotes"]
    event = lambda i: F.struct(F.when(i == 0, "occurred").otherwise(F.lit("possible")).alias("polarity"), F.when(F.col("source_row") % 2 == 0, quote).otherwise(F.array(F.lit("-"))).alias("evidence"))
    status = F.when(F.col("source_row") % 3 == 0, None).otherwise(F.lit("open"))
    events = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), event)
    predictions = gold.select("source_id", "source_row", "content_sha256", F.lit("h").alias("prediction_hash"), status.alias("case_status"), events.alias("events"))
    match = lambda i, scope, issue: F.struct(F.lit(i).alias("event_index"), F.lit(scope).alias("gold_scope"), F.lit(issue).alias("gold_issue_id"))
    no_match, no_index = F.array().cast("array<struct<event_index:int,gold_scope:string,gold_issue_id:string>>"), F.array().cast("array<int>")
    matches = F.concat(F.when(n > 0, F.array(match(0, "active", "i1"))).otherwise(no_match), F.when((n > 1) & has_back, F.array(match(1, "background", "b1"))).otherwise(no_match))
    spurious = F.concat(F.when((n > 1) & ~has_back, F.array(F.lit(1))).otherwise(no_index), F.when(n > 2, F.array(F.lit(2))).otherwise(no_index))
    adjudication = gold.select("source_id", F.lit("h").alias("prediction_hash"), matches.alias("matches"), spurious.alias("spurious"))
    out = scoring.score(gold, predictions, adjudication)
    return out.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c).cast("long").alias(c) for c, kind in out.dtypes])


def gold_records(spark, sf_dir):
    gold, _ = _gold(spark, sf_dir)
    return gold.select("source_id", "source_row", "content_sha256", "annotator_id", "case_status", F.size("issues").alias("issues"))


def adjudication_sheets(spark, sf_dir):
    """Sheets of all gold records whose text the model took."""
    gold, _ = _gold(spark, sf_dir)
    results = extraction.accepted(_extracted(spark, sf_dir)).select("source_id", "source_row", "content_sha256", "events")
    sheets = annotation.adjudication_sheet(gold.join(results.select("source_id"), "source_id", "left_semi"), results)
    first = F.get("prediction", F.lit(0))
    return sheets.select("source_id", "source_row", F.size("prediction").alias("events"), first["trigger"].alias("trigger"), F.array_join(first["behaviors"], " ").alias("behaviors"), F.array_join(first["search_terms"], " ").alias("search_terms"), "review_status")


def event_texts(spark, sf_dir):
    """What stands for the first event of each text."""
    rows = extraction.accepted(_extracted(spark, sf_dir))
    return rows.select(F.col("source_row").alias("doc_id"), F.array_join(F.get(annotation.event_evidence(F.col("events")), F.lit(0)), " ").alias("evidence"))


def pilot_trace(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_id"), F.col("doc_id").alias("source_row"), F.col("text").alias("content"), F.col("lang").alias("category"))
    out = annotation.pilot_rows(dataset.select_pilot(rows, 100, 42, strict=False), 42)
    return out.select("source_id", F.col("selection.pilot_position").alias("position"), F.col("selection.category1_stratum").alias("stratum"), F.col("selection.length_bucket").alias("length_bucket"))


# --------------------------------------------------------------------------------------------- sources and streams


def tsv_round_trip(spark, sf_dir):
    """Documents written as TSV with quotes, read again strictly as records."""
    path = Scratch(spark, "tsv").path("records")
    rows = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 9 == 0, F.lit(" NULL ")).otherwise(F.concat("text", F.lit('\t"q"\n'))).alias("case_content"))
    files.write_tsv(rows.repartition(4, "id"), path)
    back = files.load_records(spark, path)
    return back.select(F.col("source_id").cast("long").alias("doc_id"), F.sha2("case_content", 256).alias("sha"), (F.col("source_row") >= 1).alias("numbered"))


def jsonl_round_trip(spark, sf_dir):
    """Documents as JSON lines in files that are parts of one, read in many splits: each line has its number."""
    path = Scratch(spark, "jsonl").path("records")
    rows = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("case_content"))
    files.write_jsonl(rows.orderBy(F.col("source_id").cast("long")), path)
    back = files.read_jsonl(spark, path, "source_id string, case_content string", parts=True)
    return back.select(F.col("source_id").cast("long").alias("doc_id"), "source_row", F.length("case_content").alias("length"))


def record_widths(spark, sf_dir):
    """Widths of the records of a TSV file with quoted tabs and line ends."""
    path = Scratch(spark, "widths").path("file")
    rows = documents(spark, sf_dir).select(F.concat(F.lit('"'), F.regexp_replace("text", '"', '""'), F.lit('\t"'), F.expr("repeat('\tx', cast(doc_id % 4 as int))")).alias("value"))
    rows.write.text(path)
    return files.record_widths(spark, path)


def file_digests(spark, sf_dir):
    """Files as they were written: hash and length of the one-line files of nations."""
    path = Scratch(spark, "digests").path("files")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("value"))
    rows.repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    found = files.file_hashes(spark, f"{path}/*/*.txt")
    return found.select(F.regexp_extract("path", "n_nationkey=(\\d+)", 1).cast("long").alias("n_nationkey"), "length", "sha256")


def stream_event_counts(spark, sf_dir):
    """Events as a stream of files, in micro-batches, counted by hour."""
    scratch = Scratch(spark, "stream")
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    scratch.write(events.repartition(6), "in")

    def take(batch: DataFrame, number: int) -> None:
        incremental.event_counts(batch).write.mode("overwrite").parquet(f"{scratch.path('out')}/batch={number}")

    for _ in range(2):  # a second call finds nothing new
        incremental.drain(spark, scratch.path("in"), events.schema, scratch.path("state"), take, 2)
    parts = spark.read.parquet(scratch.path("out"))
    out = parts.groupBy(F.col("window.start").alias("hour"), "event_type").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    return out.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("value", 6).alias("value"))


# ------------------------------------------------------------------------------------------------------- datasets


def _built(spark, sf_dir) -> dict[str, DataFrame]:
    """The whole build over documents: two neighbours by id share an order, the entry is lang and source."""
    d = F.col("doc_id")
    day = F.date_add(F.lit("2025-07-01").cast("date"), (d % 300).cast("int")).cast("string")
    quote = F.concat(F.lit('[{"type":0,"value":"'), "lang", F.lit('-'), "source", F.lit('","label":"'), "lang", F.lit('"}]'))
    source = documents(spark, sf_dir).select(
        d.cast("string").alias("id"), F.concat(F.lit("o"), F.floor(d / 2).cast("string")).alias("order_id"), F.col("text").alias("case_content"), F.concat(day, F.lit(" 10:00:00")).alias("call_time"),
        F.when(d % 13 == 0, "1").otherwise(F.lit("0")).alias("delete_flag"), F.lit("").alias("order_invalid_type"), F.col("lang").alias("case_accord_type_one_name"), F.when(d % 3 == 0, F.lit("[]")).otherwise(quote).alias("knowledge_quote"), d.alias("source_row"),
    )
    return dataset.build_dataset(source, Scratch(spark, "dataset"))


def dataset_splits(spark, sf_dir):
    return _built(spark, sf_dir)["records"].select(F.col("rid").alias("doc_id"), "group_id", "split", F.size("refs").alias("refs"))


def dataset_catalog(spark, sf_dir):
    return _built(spark, sf_dir)["catalog"]


def query_statistics(spark, sf_dir):
    built = _built(spark, sf_dir)
    return dataset.query_set(built["records"], "dev", 1 << 30, 42, built["catalog"])[1]


def entries_of_cases(spark, sf_dir):
    """Citations of each case in one line."""
    return links(spark, sf_dir).groupBy("docid").agg(F.array_join(F.array_sort(F.collect_set("knowledge_id")), " ").alias("entries"))


# -------------------------------------------------------------------------------------------- reports and evaluation


def row_flags(spark, sf_dir):
    """Rows by whether any rule is broken and whether any text holds personal data."""
    out = profile.row_flags(documents(spark, sf_dir), {"lang": ["en", "de"], "n_chars": r"\d{1,3}"}, ["text", "source"])
    return out.groupBy("lang_violation", "n_chars_violation", "any_violation", "has_pii").agg(F.count(F.lit(1)).alias("rows"))


def column_difference(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return profile.column_difference(c, c.drop("c_name").withColumn("c_new", F.lit(1)))


def prefix_compare(spark, sf_dir):
    """The first fifty customers, each tenth with another segment, beside all of them."""
    c = table(spark, sf_dir, "customer")
    sample = c.where("c_custkey <= 50").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")))
    return profile.prefix_compare(sample, c, "c_custkey")


def columns_csv(spark, sf_dir):
    """The table of columns as its CSV file gives it back."""
    path = Scratch(spark, "columns").path("columns.csv")
    rows = report.columns_table(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment", "c_nationkey"], ["c_name", "c_mktsegment", "c_nationkey"])
    files.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path).withColumn("missing_rate", F.round("missing_rate", 9))


def repaired_jsonl(spark, sf_dir):
    """Documents as JSON lines in files that are parts of one, whose last line is torn."""
    path = Scratch(spark, "torn").path("records")
    lines = documents(spark, sf_dir).select(F.col("doc_id").alias("k"), F.to_json(F.struct(F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("case_content"))).alias("value"))
    torn = lines.agg((F.max("k") + 1).alias("k")).select("k", F.lit('{"source_id":"torn","case_con').alias("value"))
    lines.unionByName(torn).orderBy("k").select("value").write.text(path)
    back = files.read_repaired_jsonl(spark, path, "source_id string, case_content string", "source_id", parts=True)
    return back.select(F.col("source_id").cast("long").alias("doc_id"), "source_row", F.length("case_content").alias("length"))


def model_files(spark, sf_dir):
    """What a folder of files is known by: their sizes and hashes."""
    path = Scratch(spark, "model").path("files")
    table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    _, found = files.model_fingerprint(spark, path)
    return spark.createDataFrame([(f["bytes"], f["sha256"]) for f in found], "bytes long, sha256 string")


def dense_evaluation(spark, sf_dir):
    """Vectors with an id divisible by 50 ask for their own label among all vectors, in slices by id."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.array(F.col("label").cast("string")).alias("gold"), (F.col("vec_id") % 4).alias("slice"))
    links_ = e.select(F.col("vec_id").alias("docid"), F.col("label").cast("string").alias("knowledge_id"))
    groups_ = e.select(F.col("vec_id").alias("docid"), F.floor(F.col("vec_id") / 3).alias("group_id"))
    out = evaluation.dense_evaluation(asked, e.select("vec_id", "embedding"), links_, groups_, links_.where("knowledge_id <> '0'"), "slice")
    return out.select("slice", "labeled_queries", "known_target_queries", *[F.round(c, 9).alias(c) for c in ("target_catalog_coverage", "observed_recall_1", "observed_recall_5", "observed_hit_10", "known_target_recall_5")])


QUERIES = {
    f.__name__: f
    for f in (
        extraction_segments, seed_queries, encoded_shards, row_flags, column_difference, prefix_compare, columns_csv, repaired_jsonl, model_files, dense_evaluation,
        content_keys, cjk_tokens, iso_times, raw_date_profile, annotation_ids, unit_vectors, distinct_within, pii_types, dictionary, report_lines, address_index, address_parts, address_search,
        combined_search, problem_search, bm25_pool, rerank_topk, rerank_selection, judgment_pool, judgment_sheet, latency_p95, combined_grades, sliced_recall, extraction_spans, extraction_views,
        extraction_audit, extraction_errors, extraction_resumed, records_to_do, span_alignment, issue_scores, gold_records, adjudication_sheets, event_texts, pilot_trace, tsv_round_trip, jsonl_round_trip,
        record_widths, file_digests, stream_event_counts, dataset_splits, dataset_catalog, query_statistics, entries_of_cases,
    )
}

# ------------------------------------------------------------------------------------------------------------ SQL

EMAIL = r"(^|[^A-Za-z0-9_.+-])[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)+($|[^A-Za-z0-9_.-])"
MICROS = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"
TIMES = f"""times AS (SELECT event_id, CASE WHEN event_id % 8 < 3 THEN {MICROS} WHEN event_id % 8 = 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || '.000000' WHEN event_id % 8 = 4 THEN strftime(ts, '%Y-%m-%d') || ' 00:00:00.000000'
    WHEN event_id % 8 = 7 THEN substring({MICROS}, 1, 23) || '000' END AS time FROM events)"""
WORDS = "words AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents), lead AS (SELECT doc_id, text, len(w) AS n, w[1] AS one, w[2] AS two FROM words)"
SPLIT = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w <> ''))"
RERANKED = f"""{_bm25(CASES, 'hits', 10)}, rr AS (SELECT query_id, docid, h.rank AS retrieval_rank, {SPLIT.format('b.text')} AS q, {SPLIT.format('c.text')} AS d, c.text AS content FROM hits h JOIN benchmark b ON b.item_id = h.query_id JOIN cases c USING (docid)),
    rs AS (SELECT query_id, docid, retrieval_rank, content, len(list_intersect(q, d)) / greatest(1, len(q)) AS score FROM rr), reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, docid)::INT AS rank FROM rs)"""
PAIR = "'pair_' || substring(sha256('[\"' || query_id || '\",\"' || docid || '\"]'), 1, 24)"
POOL = "pool AS (SELECT query_id, docid FROM hits WHERE rank <= {0} UNION SELECT query_id, docid FROM reranked WHERE rank <= {0})"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


PLACED = f"""placed AS (SELECT c_custkey AS docid, {_list(DISTRICTS)}[c_custkey % 3 + 1] AS district, {_list(PLACES)}[c_custkey % 4 + 1] AS place, (c_custkey % 7 + 1) || '号楼' AS building, CASE WHEN c_custkey % 2 = 0 THEN translate((c_custkey % 7 + 1)::VARCHAR, '1234567', '１２３４５６７') ELSE (c_custkey % 7 + 1)::VARCHAR END || '号楼' AS written FROM customer WHERE c_custkey % 5 < 3),
    roads AS (SELECT c_custkey AS docid, {_list(ROADS)}[c_custkey % 2 + 1] AS road, (c_custkey % 11 + 1) || '号' AS house FROM customer WHERE c_custkey % 5 = 3)"""
BUILT = f"""keyed AS (SELECT doc_id, sha256(regexp_replace(text, '\\s+', '', 'g')) AS t, 'o' || (doc_id // 2) AS k FROM documents WHERE doc_id % 13 <> 0 AND trim(text, E' \\t\\n\\r') <> '' AND NOT contains(text, chr(9))), {COMPONENTS[COMPONENTS.index('edges AS') :]},
    p AS (SELECT doc_id, CASE WHEN DATE '2025-07-01' + (doc_id % 300)::INT < DATE '2026-01-01' THEN 1 WHEN DATE '2025-07-01' + (doc_id % 300)::INT < DATE '2026-02-01' THEN 2 ELSE 4 END AS period FROM keyed),
    m AS (SELECT group_id, bit_or(period) AS mask FROM comp JOIN p USING (doc_id) GROUP BY group_id),
    records AS (SELECT doc_id, group_id, CASE mask WHEN 1 THEN 'corpus' WHEN 2 THEN 'dev' WHEN 4 THEN 'test' ELSE 'cross_period' END AS split, CASE WHEN doc_id % 3 <> 0 THEN '0:' || lang || '-' || source END AS knowledge_id, lang AS label FROM comp JOIN m USING (group_id) JOIN documents USING (doc_id)),
    catalog AS (SELECT knowledge_id, label, count(DISTINCT group_id) AS support FROM records WHERE split = 'corpus' AND knowledge_id IS NOT NULL GROUP BY 1, 2)"""
SCORES = """s AS (SELECT doc_id % 4 AS n, doc_id AS r, split_part(trim(text), ' ', 1) AS q FROM documents),
    t AS (SELECT count(*) AS records, sum(1 + (r % 3 = 0)::INT)::BIGINT AS gold_active_issues, count_if(r % 2 = 0)::BIGINT AS gold_current_requests, sum(1 + 2 * (r % 3 = 0)::INT)::BIGINT AS gold_active_evidence_quotes, sum(n)::BIGINT AS predicted_issues,
        sum((n > 1 AND r % 5 <> 0)::INT + (n > 2)::INT)::BIGINT AS spurious_issues, count_if(n > 0)::BIGINT AS matched_active_issues, count_if(n > 0 AND r % 2 = 0)::BIGINT AS matched_current_requests, count_if(n > 1 AND r % 5 = 0)::BIGINT AS background_leaks,
        count_if(n > 0)::BIGINT AS correct_active_polarities, count_if(n > 0)::BIGINT AS matched_active_evidence_quotes, count_if(n > 0 AND (r % 2 = 0 OR contains('-', q)))::BIGINT AS covered_active_evidence_quotes,
        count_if(n = 1 AND r % 3 <> 0)::BIGINT AS exact_records, count_if(r % 3 <> 0)::BIGINT AS status_present_records, count_if(r % 3 <> 0 AND r % 4 <> 0)::BIGINT AS status_correct_records FROM s)"""
CJK_CLASS = "[\\x{3400}-\\x{9fff}]"
LABEL_OF = {"trigger": "原文触发", "behaviors": "行为现象"}
ASKED = [
    (1, "SELECT docid, 'named_place=' || place || ' building=' || written AS evidence FROM placed WHERE place = '幸福小区' AND building = '3号楼'", "named_place_and_building", "false"),
    (2, "SELECT docid, 'district=' || district || ' named_place=' || place FROM placed WHERE district = '武进区' AND place = '平安花园'", "named_place", "false"),
    (3, "SELECT docid, 'road=' || road || ' house_number=' || house FROM roads WHERE road = '劳动东路' AND house = '4号'", "road_and_house_number", "false"),
    (4, "SELECT docid, 'road=' || road FROM roads WHERE road = '劳动东路'", "road_surface", "false"),
    (5, "SELECT docid, 'named_place=' || place FROM placed WHERE place = '世纪广场'", "broader_named_place", "true"),
]

SQL = {
    "content_keys": "SELECT doc_id, sha256(regexp_replace(text, '\\s+', '', 'g')) AS key, sha256(regexp_replace(text, '\\s+', '', 'g')) AS plain_key FROM documents",
    "cjk_tokens": f"""WITH r AS (SELECT doc_id, regexp_extract_all(translate(lower(text), '{LATIN}', '{CJK}') || ' ab12', '{CJK_CLASS}+|[a-z0-9]+') AS r FROM documents),
        t AS (SELECT doc_id, flatten(list_transform(r, lambda x: CASE WHEN regexp_matches(x, '^{CJK_CLASS}{{2}}') THEN list_transform(range(1, length(x)), lambda i: substring(x, i, 2)) ELSE [x] END)) AS t FROM r)
        SELECT doc_id, len(t) AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens FROM t""",
    "iso_times": f"WITH {TIMES} SELECT * FROM times",
    "raw_date_profile": f"WITH {TIMES} SELECT count(*) AS total, count_if(event_id % 8 <> 6)::BIGINT AS filled, count(time) AS valid, count_if(event_id % 8 = 5)::BIGINT AS invalid, min(time) AS first, max(time) AS last FROM times",
    "annotation_ids": """SELECT conv_id, turn, 'pair_' || substring(sha256('["' || conv_id || '","' || role || '\\"' || turn || '"]'), 1, 24) AS annotation_id FROM conversations""",
    "unit_vectors": """WITH n AS (SELECT vec_id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)
        SELECT vec_id, round((e[1]::DOUBLE / n)::FLOAT::DOUBLE, 5) AS first, round((e[64]::DOUBLE / n)::FLOAT::DOUBLE, 5) AS last, 1.0::DOUBLE AS norm FROM n""",
    "distinct_within": """SELECT 'lang' AS field, 'exact' AS method, count(DISTINCT lang) AS exact_values, true AS within FROM documents UNION ALL SELECT 'source', 'exact', count(DISTINCT source), true FROM documents
        UNION ALL SELECT unnest(['text', 'n_chars', '<row>']), 'hll', NULL, true""",
    "pii_types": rf"""WITH d AS (SELECT text || CASE WHEN doc_id % 7 = 0 THEN ' 13812345678 ' ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN ' 11010519491231002X.' ELSE '' END AS text, source FROM documents), r AS (SELECT 'text' AS field, text AS raw FROM d UNION ALL SELECT 'source', source FROM d),
        f AS (SELECT field, regexp_matches(raw, '(^|\D)1[3-9]\d{{9}}(\D|$)') AS m, regexp_matches(raw, '(^|\D)\d{{17}}[\dXx](\D|$)') AS i, regexp_matches(raw, '{EMAIL}') AS e FROM r WHERE raw IS NOT NULL)
        SELECT field, count_if(m)::BIGINT AS mobile_rows, count_if(i)::BIGINT AS citizen_id_rows, count_if(e)::BIGINT AS email_rows, count_if(m OR i OR e)::BIGINT AS pii_rows FROM f GROUP BY field""",
    "dictionary": """WITH r AS (SELECT 'c_name' AS field, c_name AS raw, 'name' AS meaning, 'text' AS kind FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR, 'nation', 'unmapped' FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment, 'unmapped', 'unmapped' FROM customer)
        SELECT field, count(*) AS total, count(raw) AS filled, max(length(trim(raw))) AS max_length, meaning, kind FROM r GROUP BY field, meaning, kind""",
    "report_lines": """WITH t AS (SELECT c_mktsegment AS v, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5), r AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) + 1 AS line, n / sum(n) OVER () AS share FROM t)
        SELECT 0 AS line, '| Segment | Rows | Share |' AS text UNION ALL SELECT 1, '|---|---|---|' UNION ALL SELECT line::INT, '| ' || v || '\\|x | ' || n || ' | ' || printf('%.2f', 100 * share::DOUBLE) || '% |' FROM r""",
    "address_index": f"""WITH {PLACED}, e AS (SELECT docid, 'district' AS kind, district AS normalized, district AS text, 6 AS start FROM placed UNION ALL SELECT docid, 'named_place', place, place, 9 FROM placed UNION ALL SELECT docid, 'building', building, written, 13 FROM placed
            UNION ALL SELECT docid, 'road', road, road, 0 FROM roads UNION ALL SELECT docid, 'house_number', house, house, 4 FROM roads)
        SELECT docid, kind, normalized, text, start::INT AS start, (start + length(text))::INT AS "end", 0::INT AS address_group FROM e""",
    "address_parts": "SELECT c_custkey AS docid, CASE WHEN c_custkey % 5 < 3 THEN 3 WHEN c_custkey % 5 = 3 THEN 2 ELSE 0 END AS mentions, CASE WHEN c_custkey % 5 < 3 THEN 'district,named_place,building' WHEN c_custkey % 5 = 3 THEN 'road,house_number' ELSE '' END AS kinds FROM customer",
    "address_search": f"WITH {PLACED}, f AS ({' UNION ALL '.join(f'''SELECT {q}::BIGINT AS query_id, '{scope}' AS scope, {broader} AS broader, * FROM ({sql})''' for q, sql, scope, broader in ASKED)}) SELECT query_id, docid, row_number() OVER (PARTITION BY query_id ORDER BY docid)::INT AS rank, scope, broader, evidence FROM f",
    "combined_search": f"""WITH {_bm25(CASES, 'hits', 20)}, r AS (SELECT docid, row_number() OVER (ORDER BY round(score, 9), docid)::INT AS rank FROM sc_hits WHERE query_id = (SELECT min(item_id) FROM benchmark) AND docid % 4 = 0 AND docid % 3 = 1)
        SELECT 'old-' || lpad(docid::VARCHAR, 9, '0') AS source_id, docid AS source_row, rank, 'named_place_and_building' AS scope, rank AS bm25_rank FROM r WHERE rank <= 10""",
    "problem_search": f"""WITH {_bm25(CASES, 'hits', 10)}, q AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS q FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark))
        SELECT 'old-' || lpad(docid::VARCHAR, 9, '0') AS source_id, rank::INT AS rank, array_to_string(list_sort(list_distinct(list_intersect(q, regexp_extract_all(lower(text), '[a-z0-9]+'))))[1:10], ' ') AS shared FROM hits JOIN q USING (query_id) JOIN cases USING (docid)""",
    "bm25_pool": f"""WITH {_bm25(CASES, 'hits', 10)}, r AS (SELECT query_id, docid, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), docid)::INT AS rank FROM sc_hits WHERE docid % 2 = 0 AND query_id % 2 = docid % 4 // 2)
        SELECT query_id, docid, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
    "rerank_topk": f"WITH {RERANKED} SELECT query_id, docid, round(score, 9) AS score, retrieval_rank, rank FROM reranked",
    "rerank_selection": f"""WITH {RERANKED}, c AS (SELECT query_id, count(*) AS candidates, count_if(score >= 0.4)::BIGINT AS accepted FROM reranked GROUP BY query_id), a AS (SELECT item_id AS query_id, coalesce(candidates, 0) AS candidates, coalesce(accepted, 0) AS accepted FROM benchmark b LEFT JOIN c ON b.item_id = c.query_id)
        SELECT query_id, accepted, candidates - accepted AS rejected, CASE WHEN candidates = 0 THEN 'no_candidates' WHEN accepted = 0 THEN 'below_relevance_threshold' WHEN accepted < 5 THEN 'fewer_than_requested' ELSE 'results_available' END AS result_status FROM a""",
    "judgment_pool": f"WITH {RERANKED}, {POOL.format(5)} SELECT query_id, docid, {PAIR} AS annotation_id FROM pool",
    "judgment_sheet": f"""WITH {RERANKED}, {POOL.format(3)} SELECT {PAIR} AS annotation_id, query_id::VARCHAR AS query_id, '''=' AS guard, (length(text) + regexp_matches(text, '^\\s*[=+\\-@]')::INT)::INT AS content_length, 2 AS problem_grade, -1 AS address_grade FROM pool JOIN cases USING (docid)""",
    "latency_p95": "SELECT quantile_disc(value, 0.95) AS p95 FROM events",
    "combined_grades": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'combined' WHEN 1 THEN 'address' ELSE 'problem' END AS mode, (CASE doc_id % 3 WHEN 0 THEN least(2 * quality, 2 - 2 * toxic) WHEN 1 THEN 2 - 2 * toxic ELSE 2 * quality END)::INT AS grade FROM labels",
    "sliced_recall": """WITH k AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS kinds FROM events GROUP BY user_id), a AS (SELECT list_sort(list_distinct(list(event_type))) AS ranking FROM events),
        q AS (SELECT hour(ts)::INT AS hour, CASE WHEN event_id % 5 > 0 THEN kinds ELSE [] END AS g, ranking FROM events JOIN k USING (user_id), a), n AS (SELECT *, list_filter(g, lambda x: x <> 'error') AS k FROM q)
        SELECT hour, count_if(len(g) > 0)::BIGINT AS labeled_queries, count_if(len(g) = 0)::BIGINT AS unlabeled_queries, count_if(len(k) > 0)::BIGINT AS known_target_queries, round(sum(len(k)) / sum(len(g)), 9) AS target_catalog_coverage,
            round(avg(len(k) / len(g)) FILTER (WHERE len(g) > 0), 9) AS catalog_recall_ceiling, round(avg(list_contains(g, ranking[1])::INT / len(g)) FILTER (WHERE len(g) > 0), 9) AS observed_recall_1, round(avg(list_contains(g, ranking[1])::INT) FILTER (WHERE len(g) > 0), 9) AS observed_hit_1,
            round(avg(list_contains(k, ranking[1])::INT / len(k)) FILTER (WHERE len(k) > 0), 9) AS known_target_recall_1, round(avg(len(list_intersect(g, ranking[1:5])) / len(g)) FILTER (WHERE len(g) > 0), 9) AS observed_recall_5 FROM n GROUP BY hour""",
    "extraction_spans": f"""WITH {WORDS} SELECT doc_id, CASE WHEN n > 2 THEN strpos(text, one) - 1 END::INT AS trigger_start, CASE WHEN n > 2 THEN strpos(text, one) - 1 + length(one) END::INT AS trigger_end, CASE WHEN n > 2 THEN strpos(text, two) - 1 END::INT AS behavior_start,
        CASE WHEN n > 2 THEN 0 END::INT AS requests, CASE WHEN n IN (1, 2) THEN 2 ELSE 1 END::INT AS attempts, CASE WHEN n IN (1, 2) THEN 'UPSTREAM_RATE_LIMITED' ELSE '' END AS error FROM lead""",
    "extraction_views": f"""WITH {WORDS} SELECT doc_id, CASE WHEN n > 2 THEN '{LABEL_OF['trigger']}：' || one || chr(10) || '{LABEL_OF['behaviors']}：' || two ELSE '' END AS evidence_core,
        CASE WHEN n > 2 THEN '问题：lead' || chr(10) || '检索词：' || CASE WHEN one = two THEN one ELSE one || '；' || two END ELSE '' END AS semantic_terms FROM lead WHERE n NOT IN (1, 2)""",
    "extraction_audit": f"""WITH {WORDS} SELECT count(*) AS records, count_if(n NOT IN (1, 2))::BIGINT AS succeeded, count_if(n IN (1, 2))::BIGINT AS failed, count_if(n > 2)::BIGINT AS events, 3 * count_if(n > 2)::BIGINT AS proposed_evidence_quotes, count_if(n > 2)::BIGINT AS rejected_evidence_quotes,
        0::BIGINT AS dropped_events, 0::BIGINT AS trigger_fallbacks, count_if(n IN (1, 2))::BIGINT AS retries, round(CASE WHEN count_if(n > 2) > 0 THEN 2 / 3 END, 9) AS exact_evidence_quote_rate FROM lead""",
    "extraction_errors": f"""WITH {WORDS}, r AS (SELECT 'polarity' AS what, 'occurred' AS value FROM lead WHERE n > 2 UNION ALL SELECT 'error_code', 'UPSTREAM_RATE_LIMITED' FROM lead WHERE n IN (1, 2) UNION ALL SELECT 'quarantined', 'UpstreamError' FROM lead WHERE n IN (1, 2))
        SELECT what, value, count(*) AS count FROM r GROUP BY 1, 2""",
    "extraction_resumed": f"""WITH {WORDS}, c AS (SELECT DISTINCT text FROM lead WHERE doc_id % 3 = 1 AND n NOT IN (1, 2)) SELECT doc_id, CASE WHEN c.text IS NOT NULL THEN 0 WHEN n IN (1, 2) THEN 2 ELSE 1 END::INT AS attempts FROM lead LEFT JOIN c USING (text) WHERE doc_id % 3 <> 0""",
    "extraction_segments": f"""{PROFILING_SQL['split_documents'][: PROFILING_SQL['split_documents'].index('SELECT doc_id, n::INT AS n, start::INT')]},
        p AS (SELECT doc_id, n, start, substring(text, start + 1, cut - start) AS part FROM r), w AS (SELECT *, list_filter(regexp_split_to_array(part, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM p),
        e AS (SELECT doc_id, n, len(w) IN (1, 2) AS bad, CASE WHEN len(w) > 2 THEN start + strpos(part, w[1]) - 1 END AS t, CASE WHEN len(w) > 2 THEN start + strpos(part, w[2]) - 1 END AS b FROM w),
        d AS (SELECT doc_id, bool_or(bad) AS bad, min(t) AS t, list(b ORDER BY n) FILTER (WHERE b IS NOT NULL) AS b FROM e GROUP BY doc_id)
        SELECT doc_id, CASE WHEN NOT bad THEN t END::INT AS trigger_start, CASE WHEN NOT bad AND t IS NOT NULL THEN array_to_string(list_transform(b[1:5], lambda x: x::VARCHAR), ' ') END AS behavior_starts, CASE WHEN bad THEN 'UPSTREAM_RATE_LIMITED' ELSE '' END AS error FROM d""",
    "seed_queries": """WITH s AS (SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS scenario, n_name, r_name || ' ' || n_nationkey AS r_name FROM nation JOIN region ON n_regionkey = r_regionkey), q AS (SELECT *, unnest(['problem', 'address', 'combined']) AS mode FROM s)
        SELECT scenario || '-' || mode AS query_id, scenario, mode, CASE WHEN scenario < 6 THEN 'calibration' ELSE 'evaluation' END AS partition, CASE WHEN mode = 'address' THEN r_name ELSE n_name END AS query, CASE WHEN mode = 'combined' THEN r_name END AS address FROM q""",
    "encoded_shards": "SELECT doc_id, 16::INT AS dimension, 1.0::DOUBLE AS norm FROM documents",
    "records_to_do": "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0",
    "span_alignment": f"""WITH {WORDS}, s AS (SELECT doc_id, text, two AS q, strpos(text, two) - 1 + doc_id % 5 AS s FROM lead WHERE n > 1), p AS (SELECT *, substring(text, s + 1, length(q)) = q AS fits, list_filter(range(0, length(text) - length(q) + 1), lambda i: substring(text, i + 1, length(q)) = q) AS places FROM s),
        d AS (SELECT *, list_min(list_transform(places, lambda i: abs(i - s))) AS near FROM p), f AS (SELECT *, list_filter(places, lambda i: abs(i - s) = near) AS best FROM d)
        SELECT doc_id, CASE WHEN fits THEN s WHEN len(best) = 1 THEN best[1] END::INT AS start, CASE WHEN fits THEN false WHEN len(best) = 1 THEN true END AS repaired, CASE WHEN NOT fits AND len(best) > 1 THEN 'AMBIGUOUS_EVIDENCE_POSITION' END AS error FROM f""",
    "issue_scores": f"""WITH {SCORES}, r AS (SELECT *, matched_active_issues / predicted_issues AS p, matched_active_issues / gold_active_issues AS c FROM t)
        SELECT * EXCLUDE (p, c), round(p, 9) AS issue_precision, round(c, 9) AS issue_recall, round(CASE WHEN p + c = 0 THEN 0 ELSE 2 * p * c / (p + c) END, 9) AS issue_f1, round(matched_current_requests / gold_current_requests, 9) AS current_request_recall, round(background_leaks / predicted_issues, 9) AS background_leakage_rate,
            round(spurious_issues / predicted_issues, 9) AS spurious_issue_rate, round(correct_active_polarities / matched_active_issues, 9) AS active_polarity_accuracy, round(covered_active_evidence_quotes / gold_active_evidence_quotes, 9) AS active_evidence_quote_recall,
            round(covered_active_evidence_quotes / matched_active_evidence_quotes, 9) AS matched_issue_evidence_quote_recall, round(exact_records / records, 9) AS exact_record_rate, round(status_present_records / records, 9) AS case_status_prediction_coverage, round(status_correct_records / status_present_records, 9) AS case_status_accuracy FROM r""",
    "gold_records": "SELECT doc_id::VARCHAR AS source_id, doc_id AS source_row, sha256(text) AS content_sha256, 'me' AS annotator_id, CASE WHEN doc_id % 4 = 0 THEN 'resolved' ELSE 'open' END AS case_status, (1 + (doc_id % 3 = 0)::INT + (doc_id % 5 = 0)::INT)::INT AS issues FROM documents",
    "adjudication_sheets": f"""WITH {WORDS} SELECT doc_id::VARCHAR AS source_id, doc_id AS source_row, (n > 2)::INT AS events, CASE WHEN n > 2 THEN one END AS trigger, CASE WHEN n > 2 THEN two END AS behaviors, CASE WHEN n > 2 THEN CASE WHEN one = two THEN one ELSE one || ' ' || two END END AS search_terms, 'pending' AS review_status FROM lead WHERE n NOT IN (1, 2)""",
    "event_texts": f"WITH {WORDS} SELECT doc_id, CASE WHEN n > 2 THEN CASE WHEN one = two THEN one ELSE one || ' ' || two END END AS evidence FROM lead WHERE n NOT IN (1, 2)",
    "pilot_trace": f"SELECT source_id, row_number() OVER (ORDER BY turn, category, length_bucket)::INT AS position, category AS stratum, length_bucket FROM ({RETRIEVAL_SQL['pilot_strata']})",
    "tsv_round_trip": "SELECT doc_id, sha256(CASE WHEN doc_id % 9 = 0 THEN '' ELSE text || chr(9) || '\"q\"' || chr(10) END) AS sha, true AS numbered FROM documents",
    "jsonl_round_trip": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS source_row, length(text)::INT AS length FROM documents",
    "record_widths": "SELECT 1 + doc_id % 4 AS width, count(*) AS records FROM documents GROUP BY 1",
    "file_digests": "SELECT n_nationkey::BIGINT AS n_nationkey, strlen(n_name) + 1 AS length, sha256(n_name || chr(10)) AS sha256 FROM nation",
    "stream_event_counts": "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2",
    "dataset_splits": f"WITH RECURSIVE {BUILT} SELECT doc_id, group_id, split, (knowledge_id IS NOT NULL)::INT AS refs FROM records",
    "dataset_catalog": f"WITH RECURSIVE {BUILT} SELECT * FROM catalog",
    "query_statistics": f"""WITH RECURSIVE {BUILT}, s AS (SELECT min(doc_id) AS doc_id FROM records WHERE split = 'dev' GROUP BY group_id), g AS (SELECT r.knowledge_id, r.knowledge_id IN (SELECT knowledge_id FROM catalog) AS known FROM s JOIN records r USING (doc_id))
        SELECT count(*) AS queries, count(knowledge_id) AS labeled, count(*) - count(knowledge_id) AS unlabeled, count(knowledge_id) AS targets, count_if(knowledge_id IS NOT NULL AND known)::BIGINT AS in_catalog, count(knowledge_id) - count_if(knowledge_id IS NOT NULL AND known)::BIGINT AS unseen FROM g""",
    "row_flags": rf"""WITH f AS (SELECT lang NOT IN ('en', 'de') AS lang_violation, n_chars > 999 AS n_chars_violation, regexp_matches(text, '(^|\D)1[3-9]\d{{9}}(\D|$)') OR regexp_matches(text, '(^|\D)\d{{17}}[\dXx](\D|$)') OR regexp_matches(text, '{EMAIL}') AS has_pii FROM documents)
        SELECT lang_violation, n_chars_violation, lang_violation OR n_chars_violation AS any_violation, has_pii, count(*) AS rows FROM f GROUP BY 1, 2, 3, 4""",
    "column_difference": "SELECT column_name AS \"column\", CASE WHEN column_name = 'c_name' THEN 'removed' ELSE 'shared' END AS state FROM (DESCRIBE customer) UNION ALL SELECT 'c_new', 'added'",
    "prefix_compare": "SELECT count(*) AS logical_records, true AS header_matches, count_if(c_custkey % 10 = 0 AND c_mktsegment IS NOT NULL)::BIGINT AS prefix_row_mismatches, count_if(c_custkey % 10 = 0 AND c_mktsegment IS NOT NULL) = 0 AS is_exact_prefix FROM customer WHERE c_custkey <= 50",
    "columns_csv": f"""WITH c AS ({_columns('customer', ['c_name', 'c_mktsegment', 'c_nationkey'])}), d AS (SELECT unnest(['c_name', 'c_mktsegment', 'c_nationkey']) AS field, unnest([count(DISTINCT c_name), count(DISTINCT c_mktsegment), count(DISTINCT c_nationkey)]) AS n FROM customer)
        SELECT field AS name, total, filled, total - filled AS missing, round((total - filled) / total, 9) AS missing_rate, blank, null_literal, n AS "distinct", 'exact' AS distinct_method, min_length AS length_min, p50 AS length_p50, p95 AS length_p95, p99 AS length_p99, max_length AS length_max, trimmed AS trimmed_rows, multiline AS multiline_rows, control AS control_character_rows FROM c JOIN d USING (field)""",
    "repaired_jsonl": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS source_row, length(text)::INT AS length FROM documents",
    "model_files": "SELECT strlen(n_name) + 1 AS bytes, sha256(n_name || chr(10)) AS sha256 FROM nation",
    "dense_evaluation": f"""WITH {_dense('hits', 50)}, links AS (SELECT vec_id AS docid, label::VARCHAR AS knowledge_id FROM embeddings), refs AS (SELECT docid, 1 AS refs FROM links), groups AS (SELECT vec_id AS docid, vec_id // 3 AS group_id FROM embeddings),
        {_vote('(SELECT query_id, docid, rank FROM hits)', 10)}, q AS (SELECT vec_id AS query_id, vec_id % 4 AS slice, label::VARCHAR AS gold, label <> 0 AND EXISTS (SELECT 1 FROM embeddings x WHERE x.label = e.label) AS known FROM embeddings e WHERE vec_id % 50 = 0),
        r AS (SELECT slice, known, rank FROM q LEFT JOIN votes v ON v.query_id = q.query_id AND v.knowledge_id = q.gold)
        SELECT slice, count(*) AS labeled_queries, count_if(known)::BIGINT AS known_target_queries, round(avg(known::INT), 9) AS target_catalog_coverage, round(avg((coalesce(rank, 99) <= 1)::INT), 9) AS observed_recall_1, round(avg((coalesce(rank, 99) <= 5)::INT), 9) AS observed_recall_5,
            round(avg((coalesce(rank, 99) <= 10)::INT), 9) AS observed_hit_10, round(avg((coalesce(rank, 99) <= 5)::INT) FILTER (WHERE known), 9) AS known_target_recall_5 FROM r GROUP BY slice""",
    "entries_of_cases": f"WITH {CASES}, {LINKS} SELECT docid, string_agg(knowledge_id, ' ' ORDER BY knowledge_id) AS entries FROM links GROUP BY docid",
}
