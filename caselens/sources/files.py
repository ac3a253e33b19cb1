"""Readers and sinks: strict and tolerant TSV, JSON lines, CSV, Markdown, reports and manifests.

Tables go through Spark on both sides. Reports are small driver objects; they are written beside their target and put in place by a
rename, or exclusively where a file must not exist yet."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from contextlib import contextmanager
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from caselens.functions.batches import by_pieces
from caselens.functions.text import loader_value, markdown_cell, percent
from caselens.operators.dataset import require_unique
from caselens.sources import quoted

CORRUPT = "_corrupt"


# ---------------------------------------------------------------------------------------------------------- readers


def header(spark: SparkSession, path: str, sep: str = "\t") -> list[str]:
    """Column names of a file, without a byte-order mark; repeated names are an error."""
    first = spark.read.text(path).limit(1).collect()
    names = first[0][0].removeprefix("\ufeff").split(sep) if first else []
    names = [n.strip('"') for n in names]
    if len(set(names)) < len(names):
        raise ValueError("a column name is repeated")
    return names


def numbered(read: DataFrame, parts: bool = False) -> DataFrame:
    """A frame as a file reader gives it, with source_row: the place of each row in its file, from 1. parts: the files are parts of one, in
    order of their names, as a sorted frame writes them, and numbers go on from file to file.

    A file may be read in several splits, dealt to partitions in any order. One pass counts the rows of each split, and a row's place is
    that of its split plus its own inside; one row a split is broadcast."""
    marks = {"__file": F.col("_metadata.file_path"), "__at": F.col("_metadata.file_block_start"), "__n": F.monotonically_increasing_id()}
    rows = read.select("*", *[c.alias(name) for name, c in marks.items()])
    splits = rows.groupBy("__file", "__at").agg(F.count(F.lit(1)).alias("m"), F.min("__n").alias("__first"))
    # Spark pads the number of a part file to five digits; longer ones come later.
    order = Window.orderBy(F.length("__file"), "__file", "__at") if parts else Window.partitionBy("__file").orderBy("__at")
    before = F.coalesce(F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("__file", "__at", "__first", before.alias("__before"))
    placed = rows.join(F.broadcast(splits), ["__file", "__at"])
    return placed.withColumn("source_row", F.col("__before") + F.col("__n") - F.col("__first") + 1).select(*read.columns, "source_row")


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema)


def read_tsv(spark: SparkSession, path: str, required: set[str] | None = None, strict: bool = True) -> DataFrame:
    """All columns as text, with source_row from 1. strict: a row of another width is an error; otherwise it is marked in _corrupt.

    Quoted values may hold tabs and line ends; a file is read in splits all the same (`quoted`). Files are numbered apart."""
    names = header(spark, path)
    missing = (required or set()) - set(names)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    schema = StructType([StructField(n, StringType()) for n in names] + ([] if strict else [StructField(CORRUPT, StringType())]))
    options = {"sep": "\t", "escape": '"', "mode": "FAILFAST" if strict else "PERMISSIVE", "maxCharsPerColumn": "-1", **AS_IT_IS}
    if not strict:
        options["columnNameOfCorruptRecord"] = CORRUPT
    parsed = F.from_csv("value", _ddl(schema), options)
    rows = quoted.records(spark, path).where("record > 0")
    if strict:
        rows = rows.where(parsed.isNotNull())  # an error for any row, whichever columns are read
    return rows.select(parsed.alias("r"), F.col("record").alias("source_row")).select("r.*", "source_row")


def read_jsonl(spark: SparkSession, path: str, schema: str, parts: bool = False) -> DataFrame:
    """JSON lines, parted at line feeds only; blank lines count for source_row and give no record. parts: as in `numbered`."""
    rows = numbered(spark.read.option("lineSep", "\n").text(path), parts)
    return rows.where(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), "source_row").select("r.*", "source_row")


def load_records(spark: SparkSession, path: str, id_col: str = "id") -> DataFrame:
    """source_id, case_content, source_row of a TSV or JSONL file."""
    if path.endswith((".jsonl", ".json")):
        rows = _jsonl_records(spark, path)
    else:
        raw = read_tsv(spark, path, {id_col, "case_content"})
        rows = raw.select(loader_value(F.col(id_col)).alias("source_id"), loader_value(F.col("case_content")).alias("case_content"), "source_row")
    return require_unique(rows, "source_id")


def _jsonl_records(spark: SparkSession, path: str) -> DataFrame:
    rows = numbered(spark.read.option("lineSep", "\n").text(path)).withColumnRenamed("source_row", "place").where(F.trim("value") != "")
    parsed = rows.select(F.from_json("value", "source_id string, case_content string, source_row long", {"mode": "FAILFAST"}).alias("r"), "place")
    return parsed.select("r.source_id", "r.case_content", F.coalesce("r.source_row", "place").alias("source_row"))


def read_repaired_jsonl(spark: SparkSession, path: str, schema: str, id_col: str, parts: bool = False) -> DataFrame:
    """Rows of JSON-lines files of which the last line may be torn, as a writer leaves it that was stopped: that line is left out. A line
    that is torn anywhere else, and an id that repeats, are errors. parts: as in `numbered`; only the last line of all may be torn."""
    file = F.lit("") if parts else F.col("_metadata.file_path")
    lines = numbered(spark.read.option("lineSep", "\n").text(path).select("value", file.alias("file"), "_metadata"), parts).drop("_metadata")
    parsed = lines.where(F.trim("value") != "").select("file", "source_row", F.try_parse_json("value").alias("fine"), F.from_json("value", schema).alias("r"))
    last = parsed.groupBy("file").agg(F.max("source_row").alias("last"))
    whole = parsed.join(F.broadcast(last), "file").where((F.col("source_row") < F.col("last")) | F.col("fine").isNotNull())
    checked = F.when(F.col("fine").isNull(), F.raise_error(F.lit("a line is torn"))).otherwise(F.col("r"))
    return require_unique(whole.select(checked.alias("r"), "source_row").select("r.*", "source_row"), id_col)


def model_fingerprint(spark: SparkSession, folder: str) -> tuple[str, list[dict]]:
    """(hash of a model, its configuration, vocabulary and weight files with size and hash); hidden folders don't count."""
    hashed = file_hashes(spark, folder, recursive=True)
    root = folder.rstrip("/").removeprefix("file://").removeprefix("file:")
    name = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), F.lit("^" + re.escape(root) + "/"), F.lit(""))
    fits = F.col("name").rlike(r"\.(json|txt|model|safetensors|bin)$") & ~F.col("name").rlike(r"(^|/)\.")
    files_ = [r.asDict() for r in hashed.select(name.alias("name"), F.col("length").alias("bytes"), "sha256").where(fits).orderBy("name").collect()]
    if not files_:
        raise ValueError("the folder holds no model")
    return hashlib.sha256(json.dumps(files_, sort_keys=True).encode()).hexdigest(), files_


def record_widths(spark: SparkSession, path: str) -> DataFrame:
    """width, records of TSV files; quotes are honoured, an empty line is a record of no field."""

    def run(frames):
        import csv
        import io

        import pandas as pd

        csv.field_size_limit((1 << 31) - 1)
        for frame in frames:
            widths = [len(next(csv.reader(io.StringIO(value, newline=""), delimiter="\t"), [])) if '"' in value else value.count("\t") + 1 if value else 0 for value in frame["value"]]
            counts = pd.Series(widths, dtype="int64").value_counts()
            yield pd.DataFrame({"width": counts.index, "records": counts.to_numpy()})

    found = quoted.records(spark, path, blank=True).select("value").mapInArrow(by_pieces(run, "width long, records long"), "width long, records long")
    return found.groupBy("width").agg(F.sum("records").alias("records"))


def unavailable_fields(widths: DataFrame, columns: int) -> DataFrame:
    """One row: records, and how many of them and how many fields end before the last of `columns`. widths: of record_widths."""
    short = F.greatest(F.lit(columns) - F.col("width"), F.lit(0))
    return widths.agg(F.sum("records").alias("records"), F.sum(F.when(short > 0, F.col("records")).otherwise(0)).alias("short_records"), F.sum(short * F.col("records")).alias("unavailable_fields"))


def source_facts(spark: SparkSession, path: str) -> dict:
    """path, size_bytes, sha256 and header of one table file."""
    found = file_hashes(spark, path).collect()
    if len(found) != 1:
        raise ValueError("not one file")
    return {"path": found[0]["path"], "size_bytes": found[0]["length"], "sha256": found[0]["sha256"], "header": header(spark, path)}


PIECE = 8 << 20


def streamed_sha256(path: str) -> tuple[int, str]:
    """(length, sha-256) of a file, read in pieces of 8 MiB; an error if it changes meanwhile. path: as Spark tells it, of a file system
    that pyarrow opens."""
    from pyarrow import fs

    local = re.match("(?:file:/*)?/(.*)", path)
    system, name = (fs.LocalFileSystem(), f"/{local[1]}") if local else fs.FileSystem.from_uri(quote(path, safe=":/@"))
    before, digest, length = system.get_file_info(name), hashlib.sha256(), 0
    with system.open_input_stream(name, buffer_size=0) as stream:
        while piece := stream.read(PIECE):
            digest.update(piece)
            length += len(piece)
    after = system.get_file_info(name)
    if (before.size, before.mtime) != (after.size, after.mtime) or length != after.size:
        raise ValueError(f"a file changed while it was read: {path}")
    return length, digest.hexdigest()


def file_hashes(spark: SparkSession, path: str, most: int = 64 << 20, recursive: bool = False) -> DataFrame:
    """path, length, sha256 of files that are not empty (Spark lists no others), hashed on the executors. Files of up to `most` bytes are one value of a row; larger ones, of any
    size, are read as a stream by the task that they are dealt to."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for p in pdf["path"]:
                length, sha = streamed_sha256(p)
                yield pd.DataFrame({"path": [p], "length": [length], "sha256": [sha]})

    small = found.where(F.col("length") <= most).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = found.where(F.col("length") > most).select("path", F.xxhash64("path").alias("h"))
    return small.unionByName(large.repartition("h").select("path").mapInPandas(run, "path string, length long, sha256 string"))


# ------------------------------------------------------------------------------------------------------------ sinks


def write_jsonl(frame: DataFrame, path: str) -> None:
    frame.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


#: White space at the ends of a value is part of it.
AS_IT_IS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_tsv(frame: DataFrame, path: str) -> None:
    frame.write.mode("errorifexists").options(sep="\t", header=True, quoteAll=True, escape='"', **AS_IT_IS).csv(path)


def write_csv(frame: DataFrame, path: str) -> None:
    """One file for a bounded report table."""
    frame.coalesce(1).write.mode("errorifexists").options(header=True, escape='"', **AS_IT_IS).csv(path)


def to_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False)


def write_report(path: str | Path, text: str, replace: bool = False) -> None:
    """A private file, whole or not at all; without replace the file must not exist."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True, mode=0o700)
    handle, draft = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        if replace:
            os.replace(draft, path)
        else:
            os.link(draft, path)
    finally:
        if os.path.exists(draft):
            os.unlink(draft)


def file_sha256(path: str | Path) -> str:
    """Hash of a driver file; an error if it changes meanwhile."""
    before = os.stat(path)
    with open(path, "rb") as f:
        out = hashlib.file_digest(f, "sha256").hexdigest()
    after = os.stat(path)
    if (before.st_size, before.st_mtime_ns) != (after.st_size, after.st_mtime_ns):
        raise ValueError("the file changed while it was read")
    return out


def write_manifest(folder: str | Path, version: str, **content) -> dict:
    manifest = {"version": version, **content}
    write_report(Path(folder) / "_manifest.json", to_json(manifest))
    return manifest


def read_manifest(folder: str | Path, version: str, **expected) -> dict:
    """A manifest of this version whose named parts equal the expected ones; anything else is an error."""
    manifest = json.loads((Path(folder) / "_manifest.json").read_text(encoding="utf-8"))
    wrong = [k for k, v in {"version": version, **expected}.items() if manifest.get(k) != v]
    if wrong:
        raise ValueError(f"manifest differs in {', '.join(wrong)}")
    return manifest


@contextmanager
def exclusive(path: str | Path):
    """A lock file on the driver for a build that must not run twice."""
    handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600)
    try:
        yield
    finally:
        os.close(handle)
        os.unlink(path)


def markdown_table(rows: list[dict], columns: dict[str, str]) -> str:
    """columns: field to title; floats between 0 and 1 of fields that end in _rate are shown as percentages."""
    shown = lambda f, v: percent(v) if f.endswith("_rate") else markdown_cell("" if v is None else v)
    lines = ["| " + " | ".join(columns.values()) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(shown(f, r.get(f)) for f in columns) + " |" for r in rows]) + "\n"


def annotation_page(sheet: DataFrame, title: str, most: int = 1000, checked: bool = False) -> str:
    """An HTML page with a bounded worksheet as embedded JSON; no text of it can end the script. checked: rows are gold sheets, which must
    be there, unique and of the text that their hash says. `write_report` puts the page where none is yet."""
    rows = [r.asDict(recursive=True) for r in sheet.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows on one page")
    if checked and not rows:
        raise ValueError("an empty sheet")
    if checked and (len({r.get("source_id") for r in rows}) < len(rows) or any(not r.get("source_id") or hashlib.sha256((r.get("case_content") or "").encode()).hexdigest() != r.get("content_sha256") for r in rows)):
        raise ValueError("a sheet repeats a record, or its text is not the one that was hashed")
    data = json.dumps(rows, ensure_ascii=False, allow_nan=False).replace("<", "\\u003c").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
    script = "const rows=JSON.parse(document.getElementById('rows').textContent);document.getElementById('n').textContent=rows.length;const out=document.getElementById('out');for(const r of rows){const p=document.createElement('pre');p.textContent=JSON.stringify(r,null,1);out.append(p)}"
    from html import escape

    return f'<!doctype html><meta charset="utf-8"><title>{escape(title)}</title><h1>{escape(title)} (<span id="n"></span>)</h1><div id="out"></div><script type="application/json" id="rows">{data}</script><script>{script}</script>\n'
