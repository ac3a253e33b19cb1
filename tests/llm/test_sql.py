"""Each training-data query that SQL can state, against it."""

import duckdb
import pytest

from caselens.llm import queries


def rows_of(frame):
    frame = frame.astype(object).where(frame.notna(), None).reindex(sorted(frame.columns), axis=1)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return list(frame.columns), sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    assert rows_of(queries.QUERIES[name](spark, sf).toPandas()) == rows_of(con.sql(queries.SQL[name]).df())
