"""Reranking, relevance policies, pools for blind judgment and the checks of query sets and runs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselens.functions.text import annotation_id, safe_cell
from caselens.operators.dataset import require_unique
from caselens.operators.extraction import digest
from caselens.operators.lexical import top

# Fixed values of the interchange formats.
MODES = ("problem", "address", "combined")
PARTITIONS = ("calibration", "evaluation")
POLICY_VERSION = "relevance-policy-v1"
WORKSHEET = ("annotation_id", "query_id", "mode", "query", "address", "case_content", "problem_grade", "address_grade", "related_event_group", "notes")


class Reranker(Protocol):
    identity: dict

    def score(self, query: str, docs: list[str]) -> list[float]: ...


class OverlapReranker:
    """Deterministic stand-in for a cross-encoder: the share of the query's words that the document has."""

    identity = {"kind": "overlap"}

    def score(self, query: str, docs: list[str]) -> list[float]:
        words = set(query.lower().split())
        return [len(words & set(d.lower().split())) / max(1, len(words)) for d in docs]


def rerank(candidates: DataFrame, load) -> DataFrame:
    """candidates: query_id, query, docid, content, rank. The whole pool by (-score, source_id), or docid where candidates have no
    source_id; the old rank stays as retrieval_rank."""
    require_unique(candidates, "query_id", "docid")

    def run(queries: pd.Series, contents: pd.Series, model: Reranker) -> list[float]:
        scores = pd.Series(0.0, index=queries.index)
        for query, part in contents.groupby(queries):
            own = [float(x) for x in model.score(query, part.tolist())]
            if len(own) != len(part) or not all(map(math.isfinite, own)):
                raise ValueError("reranker scores are missing or not finite")
            scores[part.index] = own
        return scores

    def scorer(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, contents in parts:
            yield run(queries, contents, model)

    scored = candidates.withColumnRenamed("rank", "retrieval_rank").withColumn("rerank_score", F.pandas_udf(scorer, "double")("query", "content"))
    return top(scored, 1 << 30, F.desc("rerank_score"), "source_id" if "source_id" in candidates.columns else "docid")


def policy_problems(policy: dict, mode: str, context: dict, top_k: int) -> list[str]:
    """Everything that keeps a policy from being applied to a search, empty for a policy made for it."""
    reach, setting = policy.get("max_top_k"), (policy.get("modes") or {}).get(mode) or {}
    number = lambda x, *kinds: isinstance(x, kinds) and not isinstance(x, bool) and math.isfinite(x)
    sound = {
        f"it is no {POLICY_VERSION}": policy.get("version") == POLICY_VERSION,
        f"it was not calibrated for {top_k} results": number(reach, int) and 1 <= top_k <= reach,
        f"{mode} was calibrated in another context": setting.get("context") == context,
        f"{mode} has no finite threshold": number(setting.get("threshold"), int, float),
    }
    return [why for why, holds in sound.items() if not holds]


def policy_threshold(policy: dict, mode: str, context: dict, top_k: int) -> float:
    """The threshold of a policy, or an error that names all that is wrong with it."""
    if problems := policy_problems(policy, mode, context, top_k):
        raise ValueError(f"relevance policy: {'; '.join(problems)}")
    return float(policy["modes"][mode]["threshold"])


def make_policy(thresholds: DataFrame, contexts: dict[str, dict], max_top_k: int, target_precision: float) -> dict:
    """thresholds: one row a mode, of metrics.calibrate."""
    modes = {r["mode"]: {"threshold": r["threshold"], "precision": r["precision"], "results": r["results"], "queries": r["queries"], "context": contexts[r["mode"]]} for r in thresholds.collect()}
    return {"version": POLICY_VERSION, "max_top_k": max_top_k, "target_precision": target_precision, "modes": modes}


def select_results(reranked: DataFrame, queries: DataFrame, top_k: int, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(at most top_k accepted results with new ranks; query_id, accepted, rejected, result_status). Rejected places are not refilled."""
    fine = F.lit(True) if threshold is None else F.col("rerank_score") >= threshold
    kept = top(reranked.where(fine).drop("rank"), top_k, F.desc("rerank_score"), "source_id" if "source_id" in reranked.columns else "docid")
    counts = reranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(fine).alias("accepted"))
    rows = queries.select("query_id").distinct().join(counts, "query_id", "left").fillna(0)
    status = F.when(F.col("candidates") == 0, "no_candidates").when(F.col("accepted") == 0, "below_relevance_threshold").when(F.col("accepted") < top_k, "fewer_than_requested").otherwise("results_available")
    return kept, rows.select("query_id", "accepted", (F.col("candidates") - F.col("accepted")).alias("rejected"), status.alias("result_status"))


def judgment_pool(baseline: DataFrame, reranked: DataFrame, depth: int = 10) -> DataFrame:
    """query_id, docid, annotation_id: what stands in the first `depth` places of either ranking, in blind order."""
    both = baseline.where(F.col("rank") <= depth).select("query_id", "docid").unionByName(reranked.where(F.col("rank") <= depth).select("query_id", "docid")).distinct()
    return both.withColumn("annotation_id", annotation_id(F.col("query_id").cast("string"), F.col("docid").cast("string"))).orderBy("annotation_id")


def worksheet(pool: DataFrame, queries: DataFrame, cases: DataFrame) -> DataFrame:
    """The cells of a judgment sheet; texts that a spreadsheet would run are quoted."""
    rows = pool.join(queries, "query_id").join(cases, "docid")
    cell = lambda c: safe_cell(F.coalesce(F.col(c), F.lit(""))).alias(c)
    blank = [F.lit("").alias(c) for c in WORKSHEET[6:]]
    return rows.select("annotation_id", F.col("query_id").cast("string").alias("query_id"), "mode", cell("query"), cell("address"), cell("case_content"), *blank).orderBy("annotation_id")


def read_judgments(sheet: DataFrame, expected: DataFrame) -> DataFrame:
    """Judged rows, or an error when ids or printed cells differ from those that were handed out."""
    require_unique(sheet, "annotation_id")
    printed = list(WORKSHEET[:6])
    given, back = (f.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in printed]) for f in (expected, sheet))
    if not given.exceptAll(back).unionByName(back.exceptAll(given)).isEmpty():
        raise ValueError("the sheet was changed in its printed cells")
    grade = lambda c: F.when(F.trim(c).rlike(r"\A[012]\z"), F.trim(c).cast("int"))
    return sheet.withColumns({"problem_grade": grade(F.col("problem_grade")), "address_grade": grade(F.col("address_grade"))})


def seed_queries(spark: SparkSession, scenarios: list[tuple[str, str]], calibration: int = 6) -> DataFrame:
    """Each scenario (problem, address) in all three modes; the first ones calibrate, the others evaluate."""
    base = spark.createDataFrame([(i, q, a, PARTITIONS[0] if i < calibration else PARTITIONS[1]) for i, (q, a) in enumerate(scenarios)], "scenario int, query string, address string, partition string")
    rows = base.select("*", F.explode(F.array(*[F.lit(m) for m in MODES])).alias("mode"))
    return rows.select(F.concat_ws("-", "scenario", "mode").alias("query_id"), "scenario", "mode", "partition", F.when(F.col("mode") == "address", F.col("address")).otherwise(F.col("query")).alias("query"), F.when(F.col("mode") == "combined", F.col("address")).alias("address"))


def _bad_query() -> Column:
    text = F.trim(F.coalesce("query", F.lit("")))
    stray = (F.col("mode") == "combined") != F.coalesce(F.trim("address") != "", F.lit(False))
    return (text == "") | ~F.col("mode").isin(*MODES) | ~F.col("partition").isin(*PARTITIONS) | stray


def validate_queries(queries: DataFrame) -> DataFrame:
    """queries, or an error: texts, modes and partitions are sound, addresses go with combined mode only, ids and definitions are
    unique, and a scenario lies in one partition."""
    if not queries.where(F.coalesce(_bad_query(), F.lit(True))).isEmpty():
        raise ValueError("a query is not sound")
    require_unique(queries, "query_id")
    require_unique(queries, "mode", "query", "address")
    if not queries.groupBy("scenario").agg(F.countDistinct("partition").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a scenario lies in both partitions")
    return queries


def validate_runs(baseline: DataFrame, reranked: DataFrame) -> None:
    """The two runs rank the same candidates, each 1 to n; the second falls in its scores."""
    key = ["query_id", "docid"]
    for run in (baseline, reranked):
        require_unique(run, *key)
        gaps = run.groupBy("query_id").agg(F.max("rank").alias("high"), F.min("rank").alias("low"), F.countDistinct("rank").alias("n"), F.count(F.lit(1)).alias("rows"))
        if not gaps.where("low <> 1 or high <> n or n <> rows").isEmpty():
            raise ValueError("ranks have gaps")
    a, b = baseline.select(*key), reranked.select(*key)
    if not a.exceptAll(b).unionByName(b.exceptAll(a)).isEmpty():
        raise ValueError("the runs rank different candidates")
    after = F.lead("rerank_score").over(Window.partitionBy("query_id").orderBy("rank"))
    if not reranked.withColumn("after", after).where("after > rerank_score").isEmpty():
        raise ValueError("scores rise down the ranking")


def policy_digest(policy: dict) -> str:
    return digest(policy)
