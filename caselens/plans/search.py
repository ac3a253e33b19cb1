"""The search façade: lexical, dense and hybrid retrieval over a corpus, alone or within an address pool, with reranking.

Each call builds one lazy plan. An address pool filters before candidates are cut, never after, and each query has its own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.functions.text import shared_keywords, tokens
from caselens.operators import address, dense, fusion, judging, lexical
from caselens.operators.dataset import require_unique

RETRIEVERS = ("bm25", "dense", "hybrid")


@dataclass
class Searcher:
    """cases: docid, source_id, source_row, content, call_time. vectors: docid, embedding. addresses: of address.build_address_index."""

    cases: DataFrame
    index: lexical.Index
    vectors: DataFrame | None = None
    encoder: dense.Encoder | None = None
    vectors_identity: dict | None = None
    addresses: DataFrame | None = None

    def _check(self, mode: str, retriever: str, address_text: str | None, top_k: int, case_k: int, rerank: bool) -> None:
        if mode not in judging.MODES or retriever not in RETRIEVERS:
            raise ValueError("unknown mode or retriever")
        if not 0 < top_k <= case_k:
            raise ValueError("top_k must lie between 1 and case_k")
        if (mode == "combined") != bool(address_text):
            raise ValueError("an address goes with combined mode")
        if rerank and mode == "address":
            raise ValueError("address queries are not reranked")
        if mode != "problem" and self.addresses is None:
            raise ValueError("no address index")
        if mode != "address" and retriever != "bm25":
            if self.vectors is None or self.encoder is None:
                raise ValueError("no dense index")
            without = lambda d: {k: v for k, v in (d or {}).items() if k not in ("batch_size", "device")}
            if without(self.vectors_identity) != without(self.encoder.identity):
                raise ValueError("the vectors are of another encoder")

    def candidates(self, queries: DataFrame, retriever: str, case_k: int, max_terms: int, pool: DataFrame | None) -> DataFrame:
        """query_id, docid, rank, route_ranks. pool: query_id, docid."""
        routes = {}
        if retriever != "dense":
            routes["bm25"] = lexical.bm25(queries, self.index, case_k, max_terms, pool, sources=self.cases)
        if retriever != "bm25":
            encoded = dense.encode_frame(queries.select("query_id", "query"), self.encoder, "query").select("query_id", "embedding")
            routes["dense"] = dense.inner_product_topk(encoded, self.vectors, case_k) if pool is None else dense.pooled_topk(encoded, self.vectors, pool, case_k)
        if len(routes) == 1:
            name, hits = next(iter(routes.items()))
            return hits.select("query_id", "docid", "rank", F.create_map(F.lit(name), F.col("rank")).alias("route_ranks"))
        return fusion.rrf(routes, case_k, "docid").select("query_id", "docid", "rank", "route_ranks")

    def search(self, query: str, mode: str = "problem", retriever: str = "hybrid", address_text: str | None = None, top_k: int = 10, case_k: int = 50, max_terms: int = 32, allow_broader: bool = False, reranker=None, threshold: float | None = None) -> DataFrame:
        """source_id, source_row, rank, content, call_time, shared_keywords, route_ranks, address (struct or null)."""
        self._check(mode, retriever, address_text, top_k, case_k, reranker is not None)
        spark, cases = self.cases.sparkSession, self.cases
        asked = spark.createDataFrame([(0, query)], "query_id long, query string")
        pool = None
        if mode != "problem":
            required = address.required_frame(spark, [(0, query if mode == "address" else address_text)])
            pool = address.search_addresses(required, self.addresses, cases, 1 << 30 if mode == "combined" else top_k, allow_broader)
        if mode == "address":
            hits = pool.select("query_id", "docid", "rank", F.lit(None).cast("map<string,int>").alias("route_ranks"))
        elif pool is not None and pool.isEmpty():
            hits = spark.createDataFrame([], "query_id long, docid long, rank int, route_ranks map<string,int>")
        else:
            hits = self.candidates(asked, retriever, case_k, max_terms, None if pool is None else pool.select("query_id", "docid"))
        rows = require_unique(hits, "query_id", "docid").join(cases, "docid", "left").crossJoin(F.broadcast(asked.select("query")))
        rows = rows.withColumn("source_id", F.coalesce("source_id", F.raise_error(F.lit("a candidate is not among the cases"))))
        score = F.lit(None).cast("double")
        if reranker is not None:
            rows = judging.select_results(judging.rerank(rows, reranker), asked, top_k, threshold)[0]
            score = F.col("rerank_score")
        if pool is not None:
            rows = rows.join(pool.select("docid", F.struct("scope", "broader", "evidence").alias("address")), "docid", "left")
        else:
            rows = rows.withColumn("address", F.lit(None).cast("string"))
        words = shared_keywords(tokens(F.col("query")), tokens(F.col("content")))
        return rows.where(F.col("rank") <= top_k).select("source_id", "source_row", "rank", "content", "call_time", words.alias("shared_keywords"), "route_ranks", score.alias("rerank_score"), "address").orderBy("rank")

    def collect_runs(self, queries: DataFrame, retriever: str, reranker, case_k: int = 50) -> tuple[DataFrame, DataFrame]:
        """(baseline, reranked) candidates of problem queries in one plan: query_id, docid, rank and the scores of the second."""
        hits = self.candidates(queries.select("query_id", "query"), retriever, case_k, 32, None)
        rows = hits.join(self.cases.select("docid", "source_id", "content"), "docid").join(queries.select("query_id", "query"), "query_id")
        return rows.select("query_id", "docid", "rank"), judging.rerank(rows, reranker)
