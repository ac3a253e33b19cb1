"""Exact vector search in blocks: vectors are grouped around pivots, blocks of queries meet those blocks of vectors that can still reach
their k-th score, as matrices, and each pair keeps its own best k."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselens.operators.lexical import top
from caselens.plans.scratch import Scratch


class Encoder(Protocol):
    """What turns texts into float32 rows; identity says which model it is."""

    identity: dict

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEncoder:
    """Deterministic stand-in for a neural encoder: signed sums over hashed words, at unit length."""

    def __init__(self, dimension: int = 64):
        self.dimension, self.identity = dimension, {"kind": "hash", "dimension": dimension}

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split() or [""]:
                h = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big")
                row[h % self.dimension] += 1 if h >> 63 else -1
            if not row.any():
                row[0] = 1
        return normalised(out, self.dimension)


def normalised(vectors: np.ndarray, dimension: int) -> np.ndarray:
    """Rows at unit length; an error for a wrong shape, values that are not finite, or norms of 1e-8 or less."""
    x = np.asarray(vectors, np.float32)
    if x.ndim != 2 or x.shape[1] != dimension or not np.isfinite(x).all():
        raise ValueError("vectors have a wrong shape or are not finite")
    norms = np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    if (norms <= 1e-8).any():
        raise ValueError("a vector has no length")
    return (x / norms).astype(np.float32)


def encode_frame(docs: DataFrame, encoder: Encoder, text_col: str = "text", out: str = "embedding") -> DataFrame:
    """docs with a column of vectors; the encoder is loaded once for each worker."""
    return docs.withColumn(out, _iterated(encoder)(F.col(text_col)))


def encode_halving(encoder: Encoder, texts: list[str]) -> np.ndarray:
    """Vectors of texts; a batch that does not fit into memory is tried as two halves, down to single texts."""
    try:
        return encoder.encode(texts)
    except MemoryError:
        if len(texts) < 2:
            raise
    half = len(texts) // 2
    return np.concatenate([encode_halving(encoder, texts[:half]), encode_halving(encoder, texts[half:])])


def truncated(docs: DataFrame, encoder: Encoder, text_col: str = "text") -> DataFrame:
    """One row: texts, and how many are longer than what the encoder reads (encoder.max_chars, if it says so)."""
    most = getattr(encoder, "max_chars", None)
    return docs.agg(F.count(text_col).alias("texts"), (F.count_if(F.length(text_col) > most) if most else F.lit(0).cast("long")).alias("truncated"))


def _iterated(encoder: Encoder):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([row.tolist() for row in encode_halving(encoder, part.fillna("").tolist())])

    return F.pandas_udf(run, "array<float>")


def _inner_products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return queries @ vectors.T


#: Differences that are held at once.
CACHED = 1 << 15


def _l1_nearness(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Negative L1 distances, one dimension at a time, for so many queries as keep the differences in a core's cache."""
    out, across = np.zeros((len(queries), len(vectors))), np.ascontiguousarray(vectors.T)
    step = max(1, CACHED // max(1, len(vectors)))
    for at in range(0, len(queries), step):
        held, own = out[at : at + step], queries[at : at + step].T
        apart = np.empty_like(held)
        for x, y in zip(own, across, strict=True):
            np.subtract(x[:, None], y[None, :], out=apart)
            np.abs(apart, out=apart)
            held -= apart
    return out


def _l2_distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    squares = (queries**2).sum(1)[:, None] + (vectors**2).sum(1)[None, :] - 2 * queries @ vectors.T
    return np.sqrt(np.maximum(squares, 0))


@dataclass(frozen=True)
class Measure:
    """A score, a metric that bounds it, and the bound: of any vector whose distance to a pivot lies in [low, high] and whose norm is at most
    `norm`, for queries (norms `size`) at distance `gap` from the pivot."""

    score: Callable[[np.ndarray, np.ndarray], np.ndarray]
    distance: Callable[[np.ndarray, np.ndarray], np.ndarray]
    bound: Callable[..., np.ndarray]


def _apart(gap, low, high):
    """The triangle inequality: no vector of the ring is nearer."""
    return np.maximum(np.maximum(gap - high, low - gap), 0)


INNER = Measure(_inner_products, _l2_distances, lambda gap, low, high, norm, size: (size**2 + norm**2 - _apart(gap, low, high) ** 2) / 2)
L1 = Measure(_l1_nearness, lambda q, v: -_l1_nearness(q, v), lambda gap, low, high, norm, size: -_apart(gap, low, high))
#: Scores agree in nine places; bounds give way by more than that.
SLACK = 1e-7


#: Up to so many vectors, finding groups takes longer than scoring all pairs; the rows are the same either way.
FEW = 1 << 15


def _pivots(vectors: DataFrame, n: int, most: int) -> np.ndarray:
    """A bounded sample of the n vectors, the same on any cluster."""
    key, vector = vectors.columns[:2]
    rows = vectors.orderBy(F.xxhash64(key), key).select(vector).limit(min(most, math.isqrt(n) + 1)).collect()
    return np.array([r[0] for r in rows], np.float64)


def _grouped(frame: DataFrame, pivots: np.ndarray, measure: Measure, block: int, name: str, scratch: Scratch, apart: bool = True) -> DataFrame:
    """Blocks of at most `block` vectors around one pivot, in order of their distance from it: number, pivot, low, high, norm, n, ids, vectors
    (float64 bytes). Ranges of (pivot, distance, id) are dealt, so a pivot that has a third of all vectors is many blocks in many tasks. Without `apart` a block may go on to the next pivot."""
    key, vector = frame.columns[:2]
    kind = frame.schema[key].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                gaps = measure.distance(np.stack(pdf[vector].to_numpy()).astype(np.float64), pivots)
                gaps = np.where(np.isnan(gaps), np.inf, gaps)
                near = gaps.argmin(1)
                yield pd.DataFrame({"pivot": near, "gap": gaps[np.arange(len(near)), near], "id": pdf[key], "vector": pdf[vector]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in chain(batches, [None]):
            held = rest if pdf is None else pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if held is None or not len(held):
                continue
            edges = [0, *((np.flatnonzero(np.diff(held["pivot"].to_numpy())) + 1).tolist() if apart else []), len(held)]
            cuts = [at for a, b in zip(edges[:-1], edges[1:], strict=True) for at in range(a, b, block)] + [len(held)]
            done = cuts if pdf is None else cuts[:-1]  # the last block may grow
            for a, b in zip(done[:-1], done[1:], strict=True):
                part = held.iloc[a:b]
                matrix = np.stack(part.vector.to_numpy()).astype(np.float64)
                yield pd.DataFrame({"pivot": [part["pivot"].iloc[0]], "low": part.gap.min(), "high": part.gap.max(), "norm": np.linalg.norm(matrix, axis=1).max(), "n": len(part), "ids": [part.id.tolist()], "vectors": [matrix.tobytes()]})
            rest = None if pdf is None else held.iloc[done[-1] :].reset_index(drop=True)

    placed = frame.select(key, vector).mapInPandas(place, f"pivot int, gap double, id {kind}, vector array<double>")
    placed = placed.repartitionByRange("pivot", "gap", "id").sortWithinPartitions("pivot", "gap", "id")
    blocks = placed.mapInPandas(pack, f"pivot int, low double, high double, norm double, n long, ids array<{kind}>, vectors binary")
    return scratch.write(blocks.withColumn("number", F.monotonically_increasing_id()), name)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(n, -1)


def _bounds(measure: Measure, pivots: np.ndarray, matrix: np.ndarray, metas: list) -> np.ndarray:
    """Bound of each query with each block; unknown ones are infinite."""
    of, low, high, norm = (np.array([m[x] for m in metas], float) for x in ("pivot", "low", "high", "norm"))
    gap = measure.distance(matrix, pivots)[:, of.astype(int)]
    out = measure.bound(gap, low, high, norm, np.linalg.norm(matrix, axis=1)[:, None])
    return np.where(np.isnan(out), np.inf, out)


def _best(score: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int):
    """Of each pair of blocks the best k for each wanted query, so that what is shuffled does not hold all pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, docs = np.asarray(row.q_ids), np.asarray(row.ids)
                wanted = np.arange(len(ids)) if row.wanted is None else np.asarray(row.wanted)
                scores = score(_unpacked(row.q_vectors, len(ids))[wanted], _unpacked(row.vectors, len(docs)))
                rounded = np.round(scores, 9)
                rounded[np.isnan(rounded)] = -np.inf
                least = np.partition(rounded, -min(k, len(docs)), axis=1)[:, -min(k, len(docs))]
                best = []
                for line, floor in zip(rounded, least, strict=True):
                    near = np.flatnonzero(line >= floor)
                    best.append(near[np.lexsort((docs[near], -line[near]))][:k])
                held, every = np.repeat(np.arange(len(best)), [len(x) for x in best]), np.concatenate(best)
                yield pd.DataFrame({"pack": row.pack, "i": wanted[held], "query_id": ids[wanted[held]], "docid": docs[every], "score": scores[held, every]})

    return run


def _packed(frame: DataFrame, block: int, ids: str, vectors: str) -> DataFrame:
    """Rows of at most `block` vectors, as they come."""
    key, vector = frame.columns[:2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), block):
                part = pdf.iloc[at : at + block]
                yield pd.DataFrame({ids: [part[key].tolist()], vectors: [np.stack(part[vector].to_numpy()).astype(np.float64).tobytes()]})

    return frame.select(key, vector).mapInPandas(run, f"{ids} array<{frame.schema[key].dataType.simpleString()}>, {vectors} binary")


class _Pruned:
    """One search: blocks of queries and of vectors, and which pairs of them are scored."""

    def __init__(self, measure: Measure, queries: DataFrame, vectors: DataFrame, k: int, block: int, most_pivots: int):
        self.scratch, self.measure, self.k = Scratch(queries.sparkSession, "vectors"), measure, k
        self.qkind, self.vkind = (f.schema[f.columns[0]].dataType.simpleString() for f in (queries, vectors))
        self.pivots = _pivots(vectors, vectors.count(), most_pivots)
        self.empty = not len(self.pivots)
        if not self.empty:
            self.q = _grouped(queries, self.pivots, measure, 256, "queries", self.scratch, apart=False).select(F.col("number").alias("pack"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
            self.v = _grouped(vectors, self.pivots, measure, block, "blocks", self.scratch)
            metas = self.v.select(F.struct("number", "pivot", "low", "high", "norm", "n").alias("m"), F.pmod(F.xxhash64("number"), F.lit(64)).alias("chunk"))
            # Bounds are judged for a block of queries and many blocks of vectors at once.
            self.metas = self.scratch.write(metas.groupBy("chunk").agg(F.collect_list("m").alias("metas")).drop("chunk"), "metas")

    def nearest_blocks(self) -> DataFrame:
        """pack, number, wanted: for each query the blocks with the highest bounds, k vectors of them at least."""
        measure, pivots, k = self.measure, self.pivots, self.k

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    bounds = _bounds(measure, pivots, _unpacked(row.q_vectors, len(row.q_ids)), row.metas)
                    n, number = np.array([m["n"] for m in row.metas]), np.array([m["number"] for m in row.metas])
                    order = np.argsort(-bounds, axis=1, kind="stable")
                    before = np.cumsum(n[order], axis=1) - n[order]
                    i, at = np.nonzero(before < k)
                    j = order[i, at]
                    yield pd.DataFrame({"pack": row.pack, "i": i, "number": number[j], "bound": bounds[i, j], "n": n[j]})

        best = self.q.crossJoin(self.metas).mapInPandas(run, "pack long, i int, number long, bound double, n long")
        before = F.sum("n").over(Window.partitionBy("pack", "i").orderBy(F.desc("bound"), "number")) - F.col("n")
        best = best.withColumn("before", before).where(F.col("before") < k)
        return best.groupBy("pack", "number").agg(F.collect_list("i").alias("wanted"))

    def within(self, bars: DataFrame) -> DataFrame:
        """pack, number, wanted: every block whose bound reaches the k-th score of a query. bars: pack, bars (array of i, bar)."""
        measure, pivots = self.measure, self.pivots

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    bar = np.full(len(row.q_ids), -np.inf)
                    for x in row.bars if row.bars is not None else []:
                        bar[x["i"]] = x["bar"]
                    bounds = _bounds(measure, pivots, _unpacked(row.q_vectors, len(row.q_ids)), row.metas)
                    reach = bounds >= (bar - SLACK * (1 + np.where(np.isfinite(bar), np.abs(bar), 0)))[:, None]
                    use = np.flatnonzero(reach.any(0))
                    if len(use):
                        yield pd.DataFrame({"pack": row.pack, "number": [row.metas[j]["number"] for j in use], "wanted": [np.flatnonzero(reach[:, j]).tolist() for j in use]})

        return self.q.join(bars, "pack", "left").crossJoin(self.metas).mapInPandas(run, "pack long, number long, wanted array<int>")

    def scored(self, pairs: DataFrame) -> DataFrame:
        """pack, i, query_id, docid, score: the best k of each pair for each wanted query."""
        met = pairs.join(self.q, "pack").join(self.v.select("number", "ids", "vectors"), "number")
        return met.mapInPandas(_best(self.measure.score, self.k), f"pack long, i int, query_id {self.qkind}, docid {self.vkind}, score double")

    def pairs(self) -> DataFrame:
        """The pairs of blocks that are scored in the end."""
        first = self.scratch.write(self.nearest_blocks(), "first")
        tried = self.scored(first).withColumn("rank", F.row_number().over(Window.partitionBy("pack", "i").orderBy(F.desc("score"))))
        bars = tried.where(F.col("rank") == self.k).groupBy("pack").agg(F.collect_list(F.struct("i", F.col("score").alias("bar"))).alias("bars"))
        return self.scratch.write(self.within(self.scratch.write(bars, "bars")), "pairs")


def _topk(measure: Measure, queries: DataFrame, vectors: DataFrame, k: int, allowed: DataFrame | None, block: int, pivots: int = 256) -> DataFrame:
    """query_id, docid, score, rank by (-score, docid). Vectors are grouped around pivots; a group whose bound stays below the k-th score
    of a query is not scored for it, by the triangle inequality. Where vectors lie apart from each other in all directions no bound
    helps, and all pairs are scored in blocks. Nothing but the pivots is collected."""
    did = vectors.columns[0]
    if allowed is not None:
        vectors = vectors.join(allowed.select(F.col(allowed.columns[0]).alias(did)).distinct(), did, "left_semi").select(*vectors.columns)
    if vectors.count() <= FEW:
        qkind, vkind = (f.schema[f.columns[0]].dataType.simpleString() for f in (queries, vectors))
        every = _packed(queries, 256, "q_ids", "q_vectors").crossJoin(_packed(vectors, 4 * block, "ids", "vectors"))
        every = every.select(F.lit(0).cast("long").alias("pack"), F.lit(None).cast("array<int>").alias("wanted"), "q_ids", "q_vectors", "ids", "vectors")
        found = every.mapInPandas(_best(measure.score, k), f"pack long, i int, query_id {qkind}, docid {vkind}, score double")
        return top(found.select("query_id", "docid", "score"), k, F.desc(F.round("score", 9)), "docid")
    search = _Pruned(measure, queries, vectors, k, block, pivots)
    if search.empty:
        return queries.sparkSession.createDataFrame([], f"query_id {search.qkind}, docid {search.vkind}, score double, rank int")
    return top(search.scored(search.pairs()).select("query_id", "docid", "score"), k, F.desc(F.round("score", 9)), "docid")


def pairs_scored(queries: DataFrame, vectors: DataFrame, k: int, measure: Measure = INNER, block: int = 1024) -> DataFrame:
    """One row: scored (pairs of a query and a vector that a search scores in the end), pairs (all of them)."""
    search = _Pruned(measure, queries, vectors, k, block, 256)
    done = search.pairs().join(search.v.select("number", "n"), "number").agg(F.sum(F.size("wanted") * F.col("n")).alias("scored"))
    return done.crossJoin(search.q.agg(F.sum(F.size("q_ids")).alias("q"))).crossJoin(search.v.agg(F.sum("n").alias("v"))).select("scored", (F.col("q") * F.col("v")).alias("pairs"))


def inner_product_topk(queries: DataFrame, vectors: DataFrame, k: int, allowed: DataFrame | None = None, block: int = 1024) -> DataFrame:
    """query_id, docid, score, rank by (-score, docid). queries, vectors: id first, then array<float>; any number of either.

    allowed (docid) filters before the cut."""
    return _topk(INNER, queries, vectors, k, allowed, block)


def pooled_topk(queries: DataFrame, vectors: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """As inner_product_topk within a pool of its own for each query. pool: query_id, docid; every pair of it is scored."""
    qid, did = queries.columns[0], vectors.columns[0]
    asked = queries.select(F.col(qid).alias("query_id"), F.col(queries.columns[1]).alias("q"))
    held = vectors.select(F.col(did).alias("docid"), F.col(vectors.columns[1]).alias("v"))
    pairs = pool.select("query_id", "docid").distinct().join(asked, "query_id").join(held, "docid")
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return top(pairs.select("query_id", "docid", product.alias("score")), k, F.desc(F.round("score", 9)), "docid")


def l1_topk(queries: DataFrame, vectors: DataFrame, k: int, allowed: DataFrame | None = None, block: int = 1024) -> DataFrame:
    """As inner_product_topk, by the smallest L1 distance; score is the negative distance."""
    return _topk(L1, queries, vectors, k, allowed, block)


def validate_shards(shards: DataFrame, dimension: int) -> None:
    """shards: shard, docid, embedding. An error unless all vectors have the size, are finite and of unit length (1e-4), and ids rise
    within each file of a shard."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    before = F.lag("docid").over(Window.partitionBy("shard", "file").orderBy("place"))
    ordered = shards.withColumns({"file": F.input_file_name(), "place": F.monotonically_increasing_id()}).withColumn("before", before)
    bad = (F.size("embedding") != dimension) | F.isnan(norm) | (F.abs(norm - 1) > 1e-4) | (F.col("before") >= F.col("docid"))
    if shards.schema["embedding"].dataType.simpleString() != "array<float>":
        raise ValueError("vectors are not of single precision")
    if not ordered.where(bad).isEmpty():
        raise ValueError("a shard of vectors is not valid")


def changed_files(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """path of files of a shard that are gone, new or of another hash than recorded. Both: path, sha256."""
    both = now.select("path", F.col("sha256").alias("a")).join(recorded.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("path")
