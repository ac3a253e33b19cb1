"""The way from records and predictions to frozen gold and adjudication sheets, as joins with checks.

Predictions are rows of extraction results: source_id, source_row, content_sha256, events (canonical JSON). Sheets never lose a row: what
is missing, repeated, changed or unfinished is an error that names how many rows are concerned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.text import strip
from caselens.operators.dataset import require_unique
from caselens.operators.scoring import must_be_empty, validate_gold
from caselens.plans.scratch import Scratch

ANNOTATION_VERSION, ADJUDICATION_VERSION, PILOT_VERSION = "gold-sheet-v1", "adjudication-sheet-v1", "pilot-v1"
_SPANS = "array<struct<text:string,start:int,end:int>>"
EVENTS = f"""array<struct<normalized_event_type:string,polarity:string,trigger:struct<text:string,start:int,end:int>,actors:{_SPANS},objects:{_SPANS},behaviors:{_SPANS},impacts:{_SPANS},
    requests:{_SPANS},time_expressions:{_SPANS},locations:array<struct<evidence:struct<text:string,start:int,end:int>,kind:string,normalized_name:string>>,search_terms:array<string>>>"""


def prediction_hash(events: Column) -> Column:
    """sha-256 of a prediction; events is canonical JSON, so equal predictions have equal hashes."""
    return F.sha2(events, 256)


def prediction_context(events: Column) -> Column:
    """What a reviewer sees of each predicted event: its place in the list, type, polarity, and the texts of trigger, behaviours, impacts
    and requests."""
    texts = lambda spans: F.filter(F.transform(F.coalesce(spans, F.array().cast(_SPANS)), lambda s: s.text), lambda t: t != "")
    shown = lambda e, i: F.struct(
        i.alias("event_index"), e.normalized_event_type.alias("normalized_event_type"), e.polarity.alias("polarity"), e.trigger.text.alias("trigger"),
        texts(e.behaviors).alias("behaviors"), texts(e.impacts).alias("impacts"), texts(e.requests).alias("requests"), F.coalesce(e.search_terms, F.array().cast("array<string>")).alias("search_terms"),
    )
    return F.transform(F.from_json(events, EVENTS), shown)


def event_evidence(events: Column) -> Column:
    """array<array<string>>: the distinct texts that stand for each event, in order of the fields."""
    spans = lambda xs: F.transform(F.coalesce(xs, F.array().cast(_SPANS)), lambda s: s.text)
    fields = ("actors", "objects", "behaviors", "impacts", "requests", "time_expressions")
    own = lambda e: F.concat(F.array(e.trigger.text), *[spans(e[f]) for f in fields], F.coalesce(F.transform(e.locations, lambda x: x.evidence.text), F.array().cast("array<string>")))
    return F.transform(F.from_json(events, EVENTS), lambda e: F.array_distinct(F.filter(own(e), lambda t: t != "")))


#: A sheet of up to so many records is taken by one task.
ONE_TASK = 10_000


def first_rows(records: DataFrame, limit: int) -> DataFrame:
    """The first `limit` records by source_row. A limit that takes all of them needs no order; a large one is turned into the source_row that
    it ends at, found in ranges of the numbers alone, so that no task gets the records of others."""
    if limit <= ONE_TASK:
        return records.orderBy("source_row").limit(limit)
    if records.count() <= limit:
        return records
    marks = {"__part": F.spark_partition_id(), "__n": F.monotonically_increasing_id()}
    rows = records.select("source_row").repartitionByRange("source_row").sortWithinPartitions("source_row").withColumns(marks)
    rows = Scratch(records.sparkSession, "sheet").write(rows, "rows")
    before = 0
    for part in sorted(rows.groupBy("__part").agg(F.count(F.lit(1)).alias("m"), F.min("__n").alias("first")).collect(), key=lambda r: r["__part"]):
        if before + part.m >= limit:
            break
        before += part.m
    last = rows.where((F.col("__part") == part["__part"]) & (F.col("__n") == part.first + limit - before - 1)).first()["source_row"]
    row, tied = F.col("source_row"), F.col("source_row").eqNullSafe(F.lit(last))
    # Nulls come first in the order of rows.
    below = records.where((row < last) | row.isNull() if last is not None else F.lit(False))
    return below.unionByName(records.where(tied).limit(limit - below.count()))


def gold_worksheet(records: DataFrame, limit: int, predictions: DataFrame | None = None) -> DataFrame:
    """The first `limit` records by source_row as empty sheets, with what was predicted for them. records: source_id, source_row,
    case_content."""
    if limit < 1:
        raise ValueError("a sheet needs at least one record")
    rows = first_rows(records, limit).withColumn("content_sha256", F.sha2("case_content", 256))
    if predictions is not None:
        require_unique(predictions, "source_id")
        own = predictions.select("source_id", F.col("content_sha256").alias("__of"), prediction_context(F.col("events")).alias("prediction"))
        rows = rows.join(own, "source_id", "left")
        must_be_empty(rows.where(~F.col("__of").eqNullSafe(F.col("content_sha256"))), "a record has no prediction of its text")
    else:
        rows = rows.withColumn("prediction", F.lit(None).cast("string"))
    blank = {"annotation_version": F.lit(ANNOTATION_VERSION), "review_status": F.lit("pending"), "annotator_id": F.lit(""), "case_status": F.lit("unclear")}
    issues = F.array().cast("array<struct<scope:string,issue_id:string,is_current_request:boolean,expected_polarity:string,evidence_quotes:array<string>>>")
    return rows.withColumns(blank | {"issues": issues}).select("annotation_version", "source_id", "source_row", "content_sha256", "case_content", "prediction", "review_status", "annotator_id", "case_status", "issues")


def frozen_gold(sheet: DataFrame, records: DataFrame) -> DataFrame:
    """Finished sheets as gold, without text and prediction."""
    require_unique(sheet, "source_id")
    require_unique(records, "source_id")
    now = records.select("source_id", F.col("source_row").alias("__row"), F.sha2("case_content", 256).alias("__sha"))
    both = sheet.join(now, "source_id", "left")
    checks = {
        "a sheet is of no known record": F.col("__sha").isNull(),
        "a sheet is not complete": F.coalesce(F.col("review_status") != "complete", F.lit(True)),
        "a sheet has no annotator": F.coalesce(strip(F.col("annotator_id")) == "", F.lit(True)),
        "a record stands elsewhere now": ~F.col("source_row").eqNullSafe(F.col("__row")),
        "the text of a record has changed": ~F.col("content_sha256").eqNullSafe(F.col("__sha")),
    }
    wrong = F.lit(None).cast("string")
    for why, holds in reversed(checks.items()):
        wrong = F.when(holds, F.lit(why)).otherwise(wrong)
    found = {r.why: r.n for r in both.groupBy(wrong.alias("why")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not found:
        raise ValueError("no sheets")
    if bad := {k: v for k, v in found.items() if k}:
        raise ValueError("; ".join(f"{why} ({n})" for why, n in sorted(bad.items())))
    gold = sheet.select("source_id", "source_row", "content_sha256", strip(F.col("annotator_id")).alias("annotator_id"), "case_status", "issues")
    return validate_gold(gold, records.select("source_id", "case_content"))


def adjudication_sheet(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """A sheet for each gold record with its prediction, to be judged event by event."""
    require_unique(predictions, "source_id")
    own = predictions.select("source_id", F.col("source_row").alias("__row"), F.col("content_sha256").alias("__sha"), prediction_context(F.col("events")).alias("prediction"), prediction_hash(F.col("events")).alias("prediction_hash"))
    rows = gold.join(own, "source_id", "left")
    must_be_empty(rows.where(~F.col("source_row").eqNullSafe(F.col("__row")) | ~F.col("content_sha256").eqNullSafe(F.col("__sha"))), "a gold record has no prediction of its text")
    matches = F.array().cast("array<struct<event_index:int,gold_scope:string,gold_issue_id:string>>")
    return rows.select(F.lit(ADJUDICATION_VERSION).alias("adjudication_version"), "source_id", "source_row", "case_status", "issues", "prediction", F.lit("pending").alias("review_status"), "prediction_hash", matches.alias("matches"), F.array().cast("array<int>").alias("spurious"))


def pilot_rows(pilot: DataFrame, seed: int) -> DataFrame:
    """Rows of dataset.select_pilot with the trace of their selection: position, stratum, length bucket and seed."""
    position = F.row_number().over(_in_turns())
    trace = F.struct(position.alias("pilot_position"), F.col("category").alias("category1_stratum"), "length_bucket", F.lit(seed).alias("seed"))
    return pilot.select(F.lit(PILOT_VERSION).alias("pilot_schema_version"), "source_id", "source_row", F.col("content").alias("case_content"), "content_sha256", trace.alias("selection"))


def _in_turns():
    from pyspark.sql import Window

    # One window over the whole pilot, which its size bounds.
    return Window.orderBy("turn", "category", "length_bucket")
