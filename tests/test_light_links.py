"""Entries and groups of cases are found without shuffling texts."""

import pytest

from caselens.queries import retrieval


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(1, "a" * 30 + "x", "en", "s"), (2, "a" * 30 + "y", "en", "s"), (3, "a" * 30 + "x", "de", "s"), (4, "a" * 30 + "x", "en", "s"), (5, None, "en", "s"), (6, "", "fr", "t"), (7, None, "fr", "t")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return path


def test_links_and_groups(spark, folder):
    assert sorted(map(tuple, retrieval.links(spark, folder).collect())) == [(1, "de:s"), (1, "en:s"), (2, "en:s"), (6, "fr:t")]
    assert sorted(map(tuple, retrieval.groups(spark, folder).collect())) == [(1, 1), (2, 1), (5, 5), (6, 6)]


def test_links_are_computed_once(spark, folder):
    """What is read again is a small table, not the texts."""
    plan = retrieval.links(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.replace("knowledge_id", "") and "Exchange" not in plan
