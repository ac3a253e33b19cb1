"""Retrieval metrics, judged metrics and their statistics. Ratios with a zero denominator are null."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.plans.scratch import Scratch

CUTS = (1, 5, 10)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def f1(p: Column, r: Column) -> Column:
    return F.when(p.isNull() | r.isNull(), None).when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def observed_metrics(ranked: DataFrame, catalog: DataFrame, *slices: str) -> DataFrame:
    """ranked: query_id, gold (array), ranking (array in rank order). One row (for each slice): counts, recall and hits at 1, 5 and
    10, catalogue coverage and ceiling, recall of known targets. Queries without gold count as unlabelled only."""
    ranked = Scratch(ranked.sparkSession, "ranked").write(ranked, "rows")  # checked and used, computed once
    if not ranked.where(F.size(F.array_distinct("ranking")) < F.size("ranking")).isEmpty():
        raise ValueError("a ranking holds an id twice")
    known = catalog.select("knowledge_id").distinct()
    own = ranked.select("query_id", F.explode("gold").alias("knowledge_id")).join(known, "knowledge_id").groupBy("query_id").agg(F.collect_set("knowledge_id").alias("known"))
    rows = ranked.join(own, "query_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    labelled, has_known = F.size("gold") > 0, F.size("known") > 0
    aggs = [
        F.count_if(labelled).alias("labeled_queries"), F.count_if(~labelled).alias("unlabeled_queries"), F.count_if(has_known).alias("known_target_queries"),
        ratio(F.sum(F.when(labelled, F.size("known"))), F.sum(F.when(labelled, F.size("gold")))).alias("target_catalog_coverage"),
        F.avg(F.when(labelled, F.size("known") / F.size("gold"))).alias("catalog_recall_ceiling"),
    ]
    for k in CUTS:
        found = F.size(F.array_intersect("gold", F.slice("ranking", 1, k)))
        aggs += [
            F.avg(F.when(labelled, found / F.size("gold"))).alias(f"observed_recall_{k}"), F.avg(F.when(labelled, (found > 0).cast("double"))).alias(f"observed_hit_{k}"),
            F.avg(F.when(has_known, F.size(F.array_intersect("known", F.slice("ranking", 1, k))) / F.size("known"))).alias(f"known_target_recall_{k}"),
        ]
    return rows.groupBy(*slices).agg(*aggs)


def candidate_coverage(gold: DataFrame, hits: DataFrame, links: DataFrame) -> DataFrame:
    """One row: the mean share of a query's gold that some candidate cites. Cases without citations stay in (left join)."""
    cited = hits.join(links, "docid", "left").groupBy("query_id").agg(F.collect_set("knowledge_id").alias("cited"))
    rows = gold.where(F.size("gold") > 0).join(cited, "query_id", "left").withColumn("cited", F.coalesce("cited", F.array().cast("array<string>")))
    return rows.agg(F.count(F.lit(1)).alias("queries"), F.avg(F.size(F.array_intersect("gold", "cited")) / F.size("gold")).alias("coverage"))


def stage_attribution(gold: DataFrame, catalog: DataFrame, union_hits: DataFrame, fused_hits: DataFrame, links: DataFrame, voted: DataFrame) -> DataFrame:
    """query_id, knowledge_id, stage: where each gold entry ends, in exactly one of outside_catalog, missed_in_union,
    lost_in_fusion_cutoff, lost_in_voting, top10_hit."""
    targets = gold.select("query_id", F.explode(F.array_distinct("gold")).alias("knowledge_id"))
    cited = lambda hits, name: hits.select("query_id", "docid").join(links, "docid").select("query_id", "knowledge_id").distinct().withColumn(name, F.lit(True))
    rows = targets.join(catalog.select("knowledge_id").distinct().withColumn("known", F.lit(True)), "knowledge_id", "left")
    for frame in (cited(union_hits, "in_union"), cited(fused_hits, "in_fused"), voted.where("rank <= 10").select("query_id", "knowledge_id").distinct().withColumn("hit", F.lit(True))):
        rows = rows.join(frame, ["query_id", "knowledge_id"], "left")
    stage = (
        F.when(F.col("known").isNull(), "outside_catalog").when(F.col("in_union").isNull(), "missed_in_union").when(F.col("in_fused").isNull(), "lost_in_fusion_cutoff")
        .when(F.col("hit").isNull(), "lost_in_voting").otherwise("top10_hit")
    )
    return rows.select("query_id", "knowledge_id", stage.alias("stage"))


def paired_counts(pairs: DataFrame) -> DataFrame:
    """pairs: one, two. One row: n, mean difference two - one, wins, losses, ties."""
    d = F.col("two") - F.col("one")
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("delta"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"))


def bootstrap(differences: list[float], resamples: int = 2000, seed: int = 42) -> dict:
    """Mean and 95 % interval of paired differences, given in query order. An evaluation set is bounded by its labels."""
    if not differences:
        return {"delta": None, "ci": None}
    draw, n = random.Random(seed), len(differences)
    means = sorted(sum(draw.choices(differences, k=n)) / n for _ in range(resamples))
    return {"delta": sum(differences) / n, "ci": [means[int(0.025 * (resamples - 1))], means[int(0.975 * (resamples - 1))]]}


def bootstrap_frame(pairs: DataFrame, *by: str, resamples: int = 2000, seed: int = 42, block: int = 1 << 16, most: int = 1 << 22, piece: int = 1 << 24) -> DataFrame:
    """pairs: query_no, one, two. delta, ci_low, ci_high for each group, from the draws of `bootstrap`.

    Each draw is made once: the stream is cut into pieces of about `piece` draws, and the task of a piece jumps to its place in it. Groups
    of up to `most` rows go whole to the pieces of their resamples. Of a larger group a piece deals its draws to blocks of `block` rows, as
    (resample, place), and the blocks add them up, so that no task holds the group."""
    import numpy as np
    import pandas as pd

    from caselens.functions.twister import drawn_from

    scratch = Scratch(pairs.sparkSession, "bootstrap")
    keys = "".join(f"{c} {pairs.schema[c].dataType.simpleString()}, " for c in by)
    rows = pairs.select(*by, "query_no", (F.col("two") - F.col("one")).cast("double").alias("d"))
    # Parts lie in order of the keys and query_no; the place in a group is that of its part plus that in the part.
    rows = rows.repartitionByRange(*by, "query_no").sortWithinPartitions(*by, "query_no")
    rows = scratch.write(rows.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row")), "rows")
    parts = rows.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("m"), F.min("__row").alias("first"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("m").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = scratch.write(parts.select(*by, "__part", "first", before.alias("before"), F.sum("m").over(group).alias("n")), "parts")

    def same(left: str, right: str, *also: str):
        return [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in (*by, *also)]

    place = (F.col("p.before") + F.col("r.__row") - F.col("p.first")).alias("place")
    placed = rows.alias("r").join(F.broadcast(parts).alias("p"), same("r", "p", "__part")).select(*[f"r.{c}" for c in by], "r.d", "p.n", place)
    first_of = lambda pdf: [pdf[c].iloc[0] for c in by]

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values("place")["d"].to_numpy(np.float64)
        return pd.DataFrame([[*first_of(pdf), pdf["n"].iloc[0], pdf["block"].iloc[0], d.tobytes(), d.sum()]], columns=[*by, "n", "block", "d", "whole"])

    blocks = placed.withColumn("block", F.floor(F.col("place") / block)).groupBy(*by, "block").applyInPandas(packed, f"{keys}n long, block long, d binary, whole double")
    blocks = scratch.write(blocks, "blocks")
    groups = scratch.write(blocks.groupBy(*by).agg(F.first("n").alias("n"), (F.sum("whole") / F.first("n")).alias("delta")), "groups")
    draws = F.col("n") * resamples

    # Groups that fit: a piece is a range of resamples, at least one, and meets the blocks of its group.
    each = F.greatest(F.lit(1), F.floor(F.lit(piece) / F.col("n"))).cast("int")
    ranges = groups.where(F.col("n") <= most).select(*by, "n", each.alias("each"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), each)).alias("at"))

    def resampled(pdf: pd.DataFrame) -> pd.DataFrame:
        n, low = int(pdf["n"].iloc[0]), int(pdf["at"].iloc[0])
        d = np.concatenate([np.frombuffer(x) for x in pdf.sort_values("block")["d"]])
        high = min(resamples, low + int(pdf["each"].iloc[0]))
        draw = drawn_from(seed, low * n)
        sums = [d[(draw.random_sample(n) * n).astype(np.int64)].sum() for _ in range(low, high)]
        out = pd.DataFrame({"i": np.arange(low, high), "part": sums})
        for c, value in zip(reversed(by), reversed(first_of(pdf)), strict=True):
            out.insert(0, c, [value] * len(out))
        return out

    met = ranges.alias("a").join(blocks.alias("b"), same("a", "b") or F.lit(True)).select(*[f"a.{c}" for c in by], "a.n", "a.each", "a.at", "b.block", "b.d")
    sums = met.groupBy(*by, "at").applyInPandas(resampled, f"{keys}i long, part double")

    # Larger ones: a piece is a range of draws, dealt to the blocks that they fall into.
    starts = groups.where(F.col("n") > most).select(*by, "n", F.explode(F.sequence(F.lit(0).cast("long"), draws - 1, F.lit(piece).cast("long"))).alias("at"))

    def dealt(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                n, low = int(row["n"]), int(row["at"])
                high = min(n * resamples, low + piece)
                draw = drawn_from(seed, low)
                for at in range(low, high, 1 << 22):
                    m = min(1 << 22, high - at)
                    places = (draw.random_sample(m) * n).astype(np.int64)
                    i = (at + np.arange(m)) // n
                    order = np.argsort(places // block, kind="stable")
                    number, edge = np.unique((places // block)[order], return_index=True)
                    hits = (i * block + places % block)[order]
                    yield pd.DataFrame({**{c: [row[c]] * len(number) for c in by}, "block": number, "hits": [hits[a:b].tobytes() for a, b in zip(edge, [*edge[1:], m], strict=True)]})

    def added(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                d, hits = np.frombuffer(row["d"]), np.frombuffer(row["hits"], np.int64)
                i, back = np.unique(hits // block, return_inverse=True)
                yield pd.DataFrame({**{c: [row[c]] * len(i) for c in by}, "i": i, "part": np.bincount(back, d[hits % block])})

    hits = starts.mapInPandas(dealt, f"{keys}block long, hits binary").alias("a").join(blocks.alias("b"), same("a", "b", "block"))
    sums = sums.unionByName(hits.select(*[f"a.{c}" for c in by], "b.d", "a.hits").mapInPandas(added, f"{keys}i long, part double"))

    sums = scratch.write(sums.groupBy(*by, "i").agg(F.sum("part").alias("part")), "sums")
    means = sums.alias("s").join(F.broadcast(groups).alias("g"), same("s", "g") or F.lit(True)).select(*[f"s.{c}" for c in by], "g.delta", (F.col("s.part") / F.col("g.n")).alias("mean"))
    out = means.groupBy(*by).agg(F.first("delta").alias("delta"), F.array_sort(F.collect_list("mean")).alias("means"))
    at = lambda q: F.get("means", F.lit(int(q * (resamples - 1))))
    return out.select(*by, "delta", at(0.025).alias("ci_low"), at(0.975).alias("ci_high"))


def combined_grade(problem: Column, address: Column, mode: Column) -> Column:
    grade = F.when(mode == "combined", F.least(problem, address)).when(mode == "address", address).otherwise(problem)
    return F.when((mode == "combined") & (problem.isNull() | address.isNull()) | grade.isNull() | ~grade.isin(0, 1, 2), F.raise_error(F.lit("a judgment is blank or no grade"))).otherwise(grade)


def judged_metrics(judged: DataFrame, pool: DataFrame, k: int = 5, ndcg_k: int = 5, relevant: int = 2) -> DataFrame:
    """judged: query_id, mode, method, rank, grade; pool: query_id, mode, grade of all judged candidates. One row for each query, mode and
    method: returned, relevant_returned, precision (over k places), ndcg (null without a positive in the pool), positives."""
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    place = lambda r: F.log2(r.cast("double") + 1)
    scratch = Scratch(judged.sparkSession, "judged")
    judged, pool = scratch.write(judged, "judged"), scratch.write(pool, "pool")
    if not judged.where("grade is null").isEmpty():
        raise ValueError("a returned candidate has no judgment")
    ideal = pool.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "mode").orderBy(F.desc("grade"))))
    ideal = ideal.groupBy("query_id", "mode").agg(F.sum(F.when(F.col("r") <= ndcg_k, gain(F.col("grade")) / place(F.col("r"))).otherwise(0.0)).alias("ideal"), F.count_if(F.col("grade") >= relevant).alias("judged_pool_positives"))
    in_k, hit = F.col("rank") <= k, F.col("grade") >= relevant
    own = judged.groupBy("query_id", "mode", "method").agg(
        F.count_if(in_k).alias("returned"), F.count_if(in_k & hit).alias("relevant_returned"), F.sum(F.when(F.col("rank") <= ndcg_k, gain(F.col("grade")) / place(F.col("rank"))).otherwise(0.0)).alias("dcg")
    )
    return own.join(ideal, ["query_id", "mode"]).withColumns({"precision": F.col("relevant_returned") / k, "ndcg": ratio(F.col("dcg"), F.col("ideal"))}).drop("dcg", "ideal")


def summarised(per_query: DataFrame) -> DataFrame:
    """mode, method: means over queries, for each mode and as "all" over the modes (grouping sets)."""
    rolled = per_query.groupingSets([["mode", "method"], ["method"]], "mode", "method").agg(
        F.count(F.lit(1)).alias("queries"), F.avg("precision").alias("mean_precision"), F.avg("ndcg").alias("mean_ndcg"), F.count("ndcg").alias("ndcg_queries"),
        ratio(F.sum("relevant_returned"), F.sum("returned")).alias("returned_precision"), F.avg((F.col("returned") > 0).cast("double")).alias("query_coverage"), F.avg("returned").alias("mean_returned"),
    )
    return rolled.withColumn("mode", F.coalesce("mode", F.lit("all")))


def calibrate(scored: DataFrame, target_precision: float = 0.9, min_results: int = 5, min_queries: int = 3) -> DataFrame:
    """scored: mode, query_id, score, relevant (boolean). For each mode the threshold that accepts most results at the wanted
    precision (the lowest threshold, if equal); no row for a mode where none does. Accepted are scores at or above it. A mode's window
    has a row for each distinct score, not for each result."""
    # A query enters at its best score. Rows are summed up by score before any window sees them.
    by_score = scored.groupBy("mode", "score").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("relevant").cast("int")).alias("h"))
    fresh = scored.groupBy("mode", "query_id").agg(F.max("score").alias("score")).groupBy("mode", "score").agg(F.count(F.lit(1)).alias("q"))
    above = Window.partitionBy("mode").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = by_score.join(fresh, ["mode", "score"], "left").fillna(0, ["q"])
    rows = rows.select("mode", "score", F.sum("m").over(above).alias("results"), F.sum("q").over(above).alias("queries"), F.sum("h").over(above).alias("hits"))
    fit = rows.where((F.col("results") >= min_results) & (F.col("queries") >= min_queries) & (F.col("hits") >= target_precision * F.col("results")))
    best = fit.groupBy("mode").agg(F.max_by(F.struct("score", "results", "queries", "hits"), F.struct("results", -F.col("score"))).alias("b"))
    return best.select("mode", F.col("b.score").alias("threshold"), "b.results", "b.queries", (F.col("b.hits") / F.col("b.results")).alias("precision"))


def p95(values: DataFrame, col: str) -> DataFrame:
    """Nearest-rank 95 % quantile."""
    return ranked_quantiles(values, col, [0.95]).select(F.col("value").alias("p95"))


SLICES = 1024


def ranked_quantiles(values: DataFrame, col: str, shares: list[float], most: int = 1 << 16) -> DataFrame:
    """share, value: the value of nearest rank, the smallest that at least this share of all non-null values do not exceed (null without values).

    Ranks are found by counting, not by holding values: values are counted in 1,024 slices of the range of each wanted rank, with map-side
    combining, and only the slice that holds the rank is cut again, until at most `most` rows or one value are left in it. A pass
    shuffles 1,024 counts a task; passes end after some ten, as the range of doubles is no wider."""
    spark = values.sparkSession
    kind = values.schema[col].dataType.simpleString()
    x = F.col(col).cast("double").alias("x")
    held = Scratch(spark, "quantiles").write(values.where(F.col(col).isNotNull()).select(F.col(col).alias("v"), x), "values")
    # NaN is the largest value, as in Spark's order; it takes no part in the arithmetic of ranges.
    n, nan, low, high = held.agg(F.count(F.lit(1)), F.count_if(F.isnan("x")), F.min(F.when(~F.isnan("x"), F.col("x"))), F.max(F.when(~F.isnan("x"), F.col("x")))).first()
    out = []
    for share in shares:
        rank = max(1, math.ceil(share * n - 1e-12 * n)) if n else 0
        if not n:
            out.append((share, None))
            continue
        if rank > n - nan:
            out.append((share, held.where(F.isnan("x")).select("v").first()[0]))
            continue
        a, b, before, inside = low, high, 0, n - nan
        within = lambda: (F.col("x") >= F.lit(a)) & (F.col("x") <= F.lit(b)) & ~F.isnan("x")  # noqa: B023,E731
        while inside > most and a < b:
            width = b / SLICES - a / SLICES
            slice_ = F.least(F.lit(SLICES - 1), F.greatest(F.lit(0), F.floor((F.col("x") - F.lit(a)) / F.lit(width)))) if width > 0 and max(-a, b) < 1e300 else (F.col("x") > F.lit(a / 2 + b / 2)).cast("long")
            counts = held.where(within()).groupBy(slice_.alias("s")).agg(F.count(F.lit(1)).alias("m"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy("s").collect()
            if len(counts) == 1 and (counts[0]["a"], counts[0]["b"]) == (a, b):
                # Rounding keeps all of them in one slice: halve by the middle value that still lies between.
                middle = a / 2 + b / 2
                counts = held.where(within()).groupBy((F.col("x") > F.lit(middle)).alias("s")).agg(F.count(F.lit(1)).alias("m"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy("s").collect()
            for r in counts:
                if before + r["m"] >= rank:
                    a, b, inside = r["a"], r["b"], r["m"]
                    break
                before += r["m"]
        # The rows left in the range, counted by value: few rows, or one double (of which the exact values differ at most in what it rounds).
        left = held.where(within()).groupBy("v").agg(F.count(F.lit(1)).alias("m")).orderBy("v")
        upto = left.withColumn("upto", F.sum("m").over(Window.orderBy("v")) + F.lit(before)).where(F.col("upto") >= rank)
        out.append((share, upto.agg(F.min("v")).first()[0]))
    return spark.createDataFrame(out, f"share double, value {kind}")
