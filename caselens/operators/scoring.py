"""Scoring of extractions against gold: relational over exploded issues and matches, totals by conditional sums, rates with nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.operators.dataset import require_unique
from caselens.operators.metrics import f1, ratio

GOLD = """source_id string, source_row long, content_sha256 string, case_status string,
    issues array<struct<scope:string,issue_id:string,is_current_request:boolean,expected_polarity:string,evidence_quotes:array<string>>>"""
ADJUDICATION = "source_id string, prediction_hash string, matches array<struct<event_index:int,gold_scope:string,gold_issue_id:string>>, spurious array<int>"
PREDICTION = "source_id string, source_row long, content_sha256 string, prediction_hash string, case_status string, events array<struct<polarity:string,evidence:array<string>>>"


def must_be_empty(bad: DataFrame, why: str) -> None:
    if not bad.isEmpty():
        raise ValueError(why)


def same_keys(one: DataFrame, two: DataFrame, key: str = "source_id") -> None:
    a, b = one.select(key), two.select(key)
    must_be_empty(a.exceptAll(b).unionByName(b.exceptAll(a)), f"{key} sets differ")


def validate_gold(gold: DataFrame, sources: DataFrame) -> DataFrame:
    """Gold with unique issues whose every quote stands in the source text. sources: source_id, case_content."""
    require_unique(gold, "source_id")
    named = gold.select("source_id", F.explode("issues").alias("i")).select("source_id", "i.*")
    require_unique(named, "source_id", "scope", "issue_id")
    quoted = named.join(sources, "source_id", "left")
    must_be_empty(quoted.where(~F.coalesce(F.forall("evidence_quotes", lambda q: F.contains("case_content", q)), F.lit(False))), "a quote of the gold is not in its source")
    return gold


def validate_adjudication(gold: DataFrame, predictions: DataFrame, adjudication: DataFrame) -> None:
    """Every predicted event is matched or spurious once, every gold issue is matched at most once, and the judged prediction is the
    one at hand."""
    for frame in (predictions, adjudication):
        require_unique(frame, "source_id")
        same_keys(gold, frame)
    p = predictions.select("source_id", F.col("source_row").alias("pr"), F.col("content_sha256").alias("pc"), F.col("prediction_hash").alias("ph"), F.size("events").alias("n"))
    rows = gold.join(p, "source_id").join(adjudication, "source_id")
    must_be_empty(rows.where(~F.col("source_row").eqNullSafe(F.col("pr")) | ~F.col("content_sha256").eqNullSafe(F.col("pc")) | ~F.col("prediction_hash").eqNullSafe(F.col("ph"))), "a prediction is not the one that was judged")
    used = F.array_sort(F.concat(F.transform("matches", lambda m: m.event_index), "spurious"))
    every = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    names = F.transform("matches", lambda m: F.struct(m.gold_scope, m.gold_issue_id))
    must_be_empty(rows.where((used != every) | (F.size(F.array_distinct(names)) < F.size("matches"))), "an event or an issue is not judged exactly once")
    known = rows.select("source_id", F.explode("matches").alias("m")).select("source_id", F.col("m.gold_scope").alias("scope"), F.col("m.gold_issue_id").alias("issue_id"))
    must_be_empty(known.join(gold.select("source_id", F.explode("issues").alias("i")).select("source_id", "i.scope", "i.issue_id"), ["source_id", "scope", "issue_id"], "left_anti"), "a match names an unknown issue")


def matched_issues(gold: DataFrame, predictions: DataFrame, adjudication: DataFrame) -> DataFrame:
    """A row for each match with its issue, its event's polarity and how many of the issue's quotes the event's evidence covers."""
    matches = adjudication.select("source_id", F.explode("matches").alias("m")).select("source_id", "m.event_index", F.col("m.gold_scope").alias("scope"), F.col("m.gold_issue_id").alias("issue_id"))
    issues = gold.select("source_id", F.explode("issues").alias("i")).select("source_id", "i.*")
    events = predictions.select("source_id", F.posexplode("events").alias("event_index", "e"))
    rows = matches.join(issues, ["source_id", "scope", "issue_id"]).join(events, ["source_id", "event_index"])
    covered = F.size(F.filter("evidence_quotes", lambda q: F.exists("e.evidence", lambda s: F.contains(s, q))))
    return rows.select("source_id", "scope", "issue_id", "is_current_request", F.size("evidence_quotes").alias("quotes"), covered.alias("covered"), (F.col("e.polarity").eqNullSafe(F.col("expected_polarity"))).alias("same_polarity"))


def score_records(gold: DataFrame, predictions: DataFrame, adjudication: DataFrame) -> DataFrame:
    """A row of counts for each record."""
    active = F.filter("issues", lambda i: i.scope == "active")
    base = gold.select("source_id", F.size(active).alias("gold_active_issues"), F.size(F.filter(active, lambda i: i.is_current_request)).alias("gold_current_requests"), F.aggregate(active, F.lit(0), lambda a, i: a + F.size(i.evidence_quotes)).alias("gold_active_evidence_quotes"), F.col("case_status").alias("gold_status"))
    is_active = F.col("scope") == "active"
    m = matched_issues(gold, predictions, adjudication).groupBy("source_id").agg(
        F.count_if(is_active).alias("matched_active_issues"), F.count_if(is_active & F.col("is_current_request")).alias("matched_current_requests"), F.count_if(~is_active).alias("background_leaks"),
        F.count_if(is_active & F.col("same_polarity")).alias("correct_active_polarities"), F.sum(F.when(is_active, F.col("quotes")).otherwise(0)).alias("matched_active_evidence_quotes"), F.sum(F.when(is_active, F.col("covered")).otherwise(0)).alias("covered_active_evidence_quotes"),
    )
    rows = base.join(predictions.select("source_id", F.size("events").alias("predicted_issues"), "case_status"), "source_id").join(adjudication.select("source_id", F.size("spurious").alias("spurious_issues")), "source_id").join(m, "source_id", "left").fillna(0)
    exact = (F.col("matched_active_issues") == F.col("gold_active_issues")) & (F.col("background_leaks") == 0) & (F.col("spurious_issues") == 0)
    return rows.withColumns({"exact": exact, "status_present": F.col("case_status").isNotNull(), "status_correct": F.col("case_status").isNotNull() & F.col("case_status").eqNullSafe(F.col("gold_status"))}).drop("case_status", "gold_status")


def score(gold: DataFrame, predictions: DataFrame, adjudication: DataFrame) -> DataFrame:
    """One row: totals and rates."""
    validate_adjudication(gold, predictions, adjudication)
    rows = score_records(gold, predictions, adjudication)
    sums = [c for c, kind in rows.dtypes if kind in ("int", "bigint")]
    flags = ("exact", "status_present", "status_correct")
    totals = rows.agg(F.count(F.lit(1)).alias("records"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], *[F.count_if(F.col(c)).alias(f"{c}_records") for c in flags])
    r = lambda a, b: ratio(F.col(a), F.col(b))
    precision, recall = r("matched_active_issues", "predicted_issues"), r("matched_active_issues", "gold_active_issues")
    return totals.withColumns({
        "issue_precision": precision, "issue_recall": recall, "issue_f1": f1(precision, recall), "current_request_recall": r("matched_current_requests", "gold_current_requests"),
        "background_leakage_rate": r("background_leaks", "predicted_issues"), "spurious_issue_rate": r("spurious_issues", "predicted_issues"), "active_polarity_accuracy": r("correct_active_polarities", "matched_active_issues"),
        "active_evidence_quote_recall": r("covered_active_evidence_quotes", "gold_active_evidence_quotes"), "matched_issue_evidence_quote_recall": r("covered_active_evidence_quotes", "matched_active_evidence_quotes"),
        "exact_record_rate": r("exact_records", "records"), "case_status_prediction_coverage": r("status_present_records", "records"), "case_status_accuracy": r("status_correct_records", "status_present_records"),
    })
