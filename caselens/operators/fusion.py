"""Voting over citations and reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.operators.lexical import RRF_K, top


def vote(hits: DataFrame, links: DataFrame, groups: DataFrame, k: int = 10) -> DataFrame:
    """query_id, knowledge_id, score, rank, supporting (case ids in rank order).

    hits: query_id, docid, rank; links: docid, knowledge_id; groups: docid, group_id. A case gives each of its entries
    1 / ((60 + rank) * number of entries); of one group only the best vote for an entry counts."""
    links = links.distinct()
    refs = links.groupBy("docid").agg(F.count(F.lit(1)).alias("refs"))
    votes = hits.join(links, "docid").join(refs, "docid").join(groups, "docid").withColumn("vote", 1 / ((RRF_K + F.col("rank")) * F.col("refs")))
    best = votes.groupBy("query_id", "group_id", "knowledge_id").agg(F.max("vote").alias("vote"), F.collect_list(F.struct("rank", "docid")).alias("cases"))
    summed = best.groupBy("query_id", "knowledge_id").agg(F.sum("vote").alias("score"), F.flatten(F.collect_list("cases")).alias("cases"))
    summed = summed.withColumn("supporting", F.transform(F.array_sort("cases"), lambda c: c.docid)).drop("cases")
    return top(summed, k, F.desc(F.round("score", 12)), "knowledge_id")


def rrf(routes: dict[str, DataFrame], k: int, id_col: str) -> DataFrame:
    """query_id, <id>, score, route_ranks (map), rank: the sum of 1 / (60 + rank) over the routes, ties by id."""
    both = None
    for name, hits in routes.items():
        own = hits.select("query_id", F.col(id_col), "rank", F.lit(name).alias("route"))
        both = own if both is None else both.unionByName(own)
    fused = both.groupBy("query_id", id_col).agg(F.sum(1 / (RRF_K + F.col("rank"))).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("route", "rank")))).alias("route_ranks"))
    return top(fused, k, F.desc(F.round("score", 12)), id_col)


def checked_hits(hits: DataFrame, case_k: int) -> DataFrame:
    """hits, or an error: ranks 1 to n without gaps, n at most case_k, no id twice, source rows from 1."""
    by_query = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("docid").alias("ids"), F.countDistinct("rank").alias("ranks"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.min("source_row").alias("row"))
    bad = (F.col("n") > case_k) | (F.col("ids") < F.col("n")) | (F.col("ranks") < F.col("n")) | (F.col("low") != 1) | (F.col("high") != F.col("n")) | (F.col("row") < 1)
    if not by_query.where(bad).isEmpty():
        raise ValueError("candidates are not a ranking")
    return hits


def fuse_cases(one: DataFrame, two: DataFrame, k: int, names: tuple[str, str] = ("bm25", "dense")) -> DataFrame:
    """RRF over cases of two routes; both must agree on the source row of a case."""
    rows = one.select("docid", "source_row").unionByName(two.select("docid", "source_row")).groupBy("docid").agg(F.countDistinct("source_row").alias("n"))
    if not rows.where("n > 1").isEmpty():
        raise ValueError("routes differ in the source row of a case")
    return rrf(dict(zip(names, (one, two), strict=True)), k, "docid")
