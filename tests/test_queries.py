"""Every registered query against its SQL in DuckDB, and the counts of those that have none."""

import glob
import math

import duckdb
import pytest

from caselens import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        assert glob.glob(f"{sf}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    value = value.item() if hasattr(value, "item") else value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 8)
    return value


def rows_of(frame):
    frame = frame.astype(object).where(frame.notna(), None)
    frame = frame.reindex(sorted(frame.columns), axis=1)
    return list(frame.columns), sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    assert rows_of(catalog.QUERIES[name](spark, sf).toPandas()) == rows_of(duck.sql(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
