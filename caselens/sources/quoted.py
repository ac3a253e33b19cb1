"""Quoted TSV in many splits: a value in quotes may hold tabs and line ends, and a file is still read by many tasks.

A split does not know whether it begins inside a quoted value, so it says what it does to either state: where a line that begins outside
quotes, or inside, would end. What lines do composes, and so do splits; a scan over the splits of a file (a row each) gives every split its
state and the number of records before it. The second pass cuts records from that state. Records that lie in one split are done; the
pieces of those that cross splits are put together by their number.

Lines end at a line feed; a carriage return before it belongs to the line end where the record ends too. A quote opens a value only at its
beginning, two quotes inside a value stand for one, and what follows a closing quote up to the next tab belongs to the value."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.functions.batches import by_pieces

#: From the beginning of a value: whole values, up to one that is open at the end of the line.
_OPEN = re.compile(r'(?:(?:"(?:[^"]|"")*"(?!")[^\t]*|[^"\t][^\t]*|)\t)*"(?:[^"]|"")*\Z')
BOM = "﻿"


def opens(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted value, from either state at its beginning."""
    if '"' not in line:
        return inside
    return _OPEN.match('"' + line if inside else line) is not None


def _blank(line: str) -> bool:
    return line in ("", "\r")


def _effects(blank: bool):
    """For each run of lines of one split: where it begins, and for either starting state the end state and the records that begin."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            out = []
            for (file, at), rows in pdf.groupby(["file", "at"], sort=False):
                state, begun = [False, True], [0, 0]
                for line, quoted in zip(rows["value"], rows["value"].str.contains('"', regex=False), strict=True):
                    counts = blank or not _blank(line)
                    for i in (0, 1):
                        begun[i] += counts and not state[i]
                        if quoted:
                            state[i] = opens(line, state[i])
                out.append((file, at, rows["n"].iloc[0], *state, *begun))
            yield pd.DataFrame(out, columns=["file", "at", "n", "s0", "s1", "b0", "b1"])

    return run


def _scan(pdf: pd.DataFrame) -> pd.DataFrame:
    """State and records before each split of one file; splits with several runs of lines are put together first."""
    state, begun, out = False, 0, []
    for (file, at), runs in pdf.sort_values(["at", "n"]).groupby(["file", "at"], sort=False):
        out.append((file, at, state, begun))
        for r in runs.itertuples(index=False):
            begun += r.b1 if state else r.b0
            state = r.s1 if state else r.s0
    return pd.DataFrame(out, columns=["file", "at", "inside", "before"])


def _cut(blank: bool):
    """file, record, piece, value, whole: records of a split, and the pieces of those that reach into others."""

    def run(batches):
        at = None
        held: list[str] = []
        record = piece = 0
        inside = False
        file = ""

        def told(whole: bool):
            nonlocal held
            value, held = "\n".join(held), []
            return file, record, piece, value.removesuffix("\r") if whole else value, whole

        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if (row.file, row.at) != at:
                    if held:
                        out.append(told(False))
                    at, file, inside, record = (row.file, row.at), row.file, bool(row.inside), row.before - 1
                    # A piece begins where its split does; the first piece of a record where the record does.
                    piece, crossing = row.at, inside
                if not inside:
                    if not blank and _blank(row.value):
                        continue
                    record, crossing = record + 1, False
                held.append(row.value)
                inside = opens(row.value, inside)
                if not inside:
                    out.append(told(not crossing))
            if out:
                yield pd.DataFrame(out, columns=["file", "record", "piece", "value", "whole"])
        if held:
            yield pd.DataFrame([told(False)], columns=["file", "record", "piece", "value", "whole"])

    return run


def records(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    """file, record (from 0 in each file), value: the text of each record. blank: empty lines are records too."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    first = (F.col("at") == 0) & F.col("value").startswith(BOM)  # a mark elsewhere than in the first line is text, and no line begins with one twice
    lines = lines.withColumn("value", F.when(first, F.substring("value", 2, 1 << 30)).otherwise(F.col("value")))
    told = "file string, at long, n long, s0 boolean, s1 boolean, b0 long, b1 long"
    effects = lines.mapInArrow(by_pieces(_effects(blank), told), told)
    splits = effects.groupBy("file").applyInPandas(_scan, "file string, at long, inside boolean, before long")
    found = "file string, record long, piece long, value string, whole boolean"
    cut = lines.join(F.broadcast(splits), ["file", "at"]).select("file", "at", "value", "inside", "before").mapInArrow(by_pieces(_cut(blank), found), found)
    crossing = cut.where("not whole").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("piece", "value"))).alias("p"))
    joined = F.regexp_replace(F.array_join(F.col("p.value"), "\n"), r"\r\z", "")
    return cut.where("whole").select("file", "record", "value").unionByName(crossing.select("file", "record", joined.alias("value")))
