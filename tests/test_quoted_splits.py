"""Quoted TSV read in many splits of one file, against Python's csv module."""

import csv
import io
import random

import pytest

from caselens.sources import files, quoted


def lines_of(text):
    return text.split("\n")


@pytest.mark.parametrize("seed", range(6))
def test_a_line_ends_where_the_csv_module_says(seed):
    """Both starting states, on lines of quotes, tabs and signs."""
    rng = random.Random(seed)
    for _ in range(400):
        line = "".join(rng.choice('"""\t\tab ') for _ in range(rng.randint(0, 9)))
        for inside in (False, True):
            # The value is open if a sign in the next line still belongs to the record.
            rows = list(csv.reader(io.StringIO(('"' if inside else "") + line + "\nX\n", newline=""), delimiter="\t"))
            assert quoted.opens(line, inside) == (len(rows) == 1), (line, inside)


@pytest.fixture
def tiny_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def written(tmp_path, end="\n", bom=False, seed=1, rows=300):
    """A file of values with quotes, tabs, line ends and long passages, and its records."""
    rng = random.Random(seed)
    value = lambda: rng.choice(["", "plain", 'q"uote', "tab\tin", "two\nlines", '"', '""\n""', "x" * rng.randint(0, 900), "\n".join("a\t\"b\"" for _ in range(rng.randint(1, 60)))])
    table = [["id", "one", "two"]] + [[str(i), value(), value()] for i in range(rows)]
    out = io.StringIO(newline="")
    csv.writer(out, delimiter="\t", lineterminator=end, quoting=csv.QUOTE_MINIMAL).writerows(table)
    path = tmp_path / "records.tsv"
    path.write_bytes(("﻿" if bom else "").encode() + out.getvalue().encode())
    return str(path), table


@pytest.mark.parametrize("end,bom", [("\n", False), ("\n", True), ("\r\n", False)])
def test_one_file_in_many_splits(spark, tiny_splits, tmp_path, end, bom):
    path, table = written(tmp_path, end, bom)
    assert spark.read.text(path).rdd.getNumPartitions() > 20
    rows = files.read_tsv(spark, path).orderBy("source_row").collect()
    assert [r.source_row for r in rows] == list(range(1, len(table)))
    assert [[r.id, r.one or "", r.two or ""] for r in rows] == table[1:]
    assert {r.width: r.records for r in files.record_widths(spark, path).collect()} == {3: len(table)}


def test_a_value_over_many_splits(spark, tiny_splits, tmp_path):
    long = "\n".join(f"line {i}\twith \"quotes\"" for i in range(400))
    path = tmp_path / "a.tsv"
    path.write_text('id\tcase_content\n1\t"' + long.replace('"', '""') + '"\n2\tshort\n\n3\t"x\n\ny"\n')
    rows = files.load_records(spark, str(path)).orderBy("source_row").collect()
    assert [(r.source_id, r.case_content, r.source_row) for r in rows] == [("1", long, 1), ("2", "short", 2), ("3", "x\n\ny", 3)]
    assert {r.width: r.records for r in files.record_widths(spark, str(path)).collect()} == {2: 4, 0: 1}


def test_files_are_numbered_apart(spark, tiny_splits, tmp_path):
    (tmp_path / "d").mkdir()
    for name in "ab":
        (tmp_path / "d" / f"{name}.tsv").write_text("id\tv\n" + "".join(f'{name}{i}\t"{i}\n{i}"\n' for i in range(50)))
    rows = files.read_tsv(spark, f"{tmp_path}/d").collect()
    assert sorted((r.id, r.v, r.source_row) for r in rows) == sorted((f"{n}{i}", f"{i}\n{i}", i + 1) for n in "ab" for i in range(50))


def test_wrong_widths_and_open_values(spark, tiny_splits, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text("id\tv\n" + "".join(f"{i}\tx\n" for i in range(200)) + "200\n201\ta\tb\n")
    marked = files.read_tsv(spark, str(path), strict=False)
    assert sorted(r.id for r in marked.where(f"{files.CORRUPT} is not null").collect()) == ["200", "201"]
    with pytest.raises(Exception):  # noqa: B017  Spark's own error
        files.read_tsv(spark, str(path)).collect()
    assert {r.width: r.records for r in files.record_widths(spark, str(path)).collect()} == {2: 201, 1: 1, 3: 1}
