"""The files of a profile: one row a column as CSV, the dictionary as CSV and Markdown, and a summary. What is collected is a row for
each column of the table and the few rows of its summaries."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.operators import profile
from caselens.operators.metrics import ratio
from caselens.sources.files import markdown_table, to_json, write_csv, write_report

# The columns of the two tables.
COLUMNS = {
    "name": "field", "total": "total", "filled": "filled", "missing": "missing", "missing_rate": "missing_rate", "blank": "blank", "null_literal": "null_literal", "distinct": "distinct_values", "distinct_method": "method",
    "length_min": "min_length", "length_p50": "p50", "length_p95": "p95", "length_p99": "p99", "length_max": "max_length", "trimmed_rows": "trimmed", "multiline_rows": "multiline", "control_character_rows": "control",
}
ATTRIBUTES = ("business_name", "definition", "semantic_status", "lifecycle_stage", "serving_availability", "rag_role", "requires_confirmation", "confirmation_question", "caution")
OBSERVED = ("filled", "missing_rate", "distinct", "distinct_method")


def columns_table(frame: DataFrame, columns: list[str], exact: list[str]) -> DataFrame:
    """A row for each column: counts, lengths and how many values differ (exactly for the columns of `exact`)."""
    counts = profile.distinct_counts(frame, exact, [c for c in columns if c not in exact]).where("field <> '<row>'")
    rows = profile.column_profile(frame, columns).join(F.broadcast(counts), "field").withColumn("missing", F.col("total") - F.col("filled"))
    rows = rows.withColumn("missing_rate", ratio(F.col("missing"), F.col("total")))
    return rows.select(*[F.col(own).alias(name) for name, own in COLUMNS.items()])


def dictionary_table(columns: DataFrame, catalogue: DataFrame) -> DataFrame:
    """What the catalogue (name and the attributes, all text) says of each column, beside what was seen of it."""
    known = profile.field_dictionary(columns.select(F.col("name").alias("field"), *OBSERVED), catalogue.withColumnRenamed("name", "field"))
    return known.select(F.col("field").alias("name"), *ATTRIBUTES, *OBSERVED)


def write_profile(frame: DataFrame, columns: list[str], exact: list[str], catalogue: DataFrame, table_folder: str, report_folder: str | Path, title: str = "Profile") -> dict:
    """columns.csv and field_dictionary.csv below table_folder (any file system); profile.json, profile.md and data_dictionary.md in
    report_folder (of the driver). Returns what profile.json holds."""
    table = columns_table(frame, columns, exact).cache()
    dictionary = dictionary_table(table, catalogue)
    write_csv(table.orderBy("name"), f"{table_folder}/columns.csv")
    write_csv(dictionary.orderBy("name"), f"{table_folder}/field_dictionary.csv")
    rows, entries = ([r.asDict() for r in f.orderBy("name").collect()] for f in (table, dictionary))
    table.unpersist()
    summary = {"title": title, "rows": rows[0]["total"] if rows else 0, "columns": rows}
    folder = Path(report_folder)
    write_report(folder / "profile.json", to_json(summary), replace=True)
    shown = {"name": "Column", "filled": "Filled", "missing_rate": "Missing", "distinct": "Distinct", "distinct_method": "Method", "length_p50": "p50", "length_p95": "p95"}
    write_report(folder / "profile.md", f"# {title}\n\n{summary['rows']} rows, {len(rows)} columns.\n\n{markdown_table(rows, shown)}", replace=True)
    open_ = "".join(f"- `{e['name']}`: {e['confirmation_question']}\n" for e in entries if e["requires_confirmation"] == "true")
    write_report(folder / "data_dictionary.md", f"# Fields\n\n{markdown_table(entries, {'name': 'Column'} | {a: a for a in ATTRIBUTES})}\n## To be confirmed\n\n{open_}", replace=True)
    return summary
