"""Evaluation of the dense route in one plan: nearest cases, votes for entries, metrics for all queries and for slices of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.operators import dense, fusion, metrics
from caselens.operators.dataset import require_unique


def rankings(voted: DataFrame, id_col: str = "knowledge_id") -> DataFrame:
    """query_id, ranking: the ids of each query in order of rank."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", id_col)))
    return voted.groupBy("query_id").agg(F.transform(ordered, lambda x: x[id_col]).alias("ranking"))


def dense_evaluation(queries: DataFrame, vectors: DataFrame, links: DataFrame, groups: DataFrame, catalog: DataFrame, *slices: str, case_k: int = 50, k: int = 10) -> DataFrame:
    """queries: query_id, embedding, gold, and the slices. A row of observed_metrics for each slice. Every query has one row in the result's
    counts, also one without any hit."""
    require_unique(queries, "query_id")
    hits = dense.inner_product_topk(queries.select("query_id", "embedding"), vectors, case_k)
    voted = rankings(fusion.vote(hits, links, groups, k))
    ranked = queries.drop("embedding").join(voted, "query_id", "left").withColumn("ranking", F.coalesce("ranking", F.array().cast("array<string>")))
    return metrics.observed_metrics(ranked, catalog, *slices)


def encode_and_evaluate(queries: DataFrame, encoder: dense.Encoder, saved: str, vectors: DataFrame, links: DataFrame, groups: DataFrame, catalog: DataFrame, *slices: str, **options) -> DataFrame:
    """As dense_evaluation for queries with a text (query); their vectors are saved first and read again."""
    encoded = dense.encode_frame(queries, encoder, "query").drop("query")
    encoded.write.mode("errorifexists").parquet(saved)
    return dense_evaluation(queries.sparkSession.read.parquet(saved), vectors, links, groups, catalog, *slices, **options)
