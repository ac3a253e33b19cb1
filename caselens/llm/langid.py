"""Language ID: nearest-centroid classification. Normalised TF-IDF vectors of hashed character n-grams (1 to 3 bytes of the
lower-cased text) are compared by cosine with several centroids per language; a text farther from its nearest centroid than
that centroid's own training texts is marked as rejected.

Fit: document frequencies come from every training row (summed per bucket on the executors); centroids come from spherical
k-means on a sample of at most `max_sample` labelled rows, an equal share for each language, the smallest by hash of the id.
The model is `buckets` weights and k centroids a language, whatever the size of the corpus.

Rows: a null text, or one without a letter, gets no language ("und", score 0). Rows with a null label, null text or null id never
train. Repeated rows get equal results. A very long text is one slice, counted whole. Of centroids that are equally near the first in
order of language wins. Empty tables give an empty result; without training rows all texts are "und". Extra columns are not read."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"


def counts(texts: list[str], buckets: int) -> np.ndarray:
    """One row of n-gram counts for each text; n-grams never reach over a text's ends."""
    coded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.array([len(c) + 3 for c in coded], np.int64)
    data = np.frombuffer(b"".join(b" " + c + b"  " for c in coded), np.uint8).astype(np.uint32)
    rows, ends = np.repeat(np.arange(len(coded), dtype=np.int64) * buckets, lengths), np.cumsum(lengths)
    rows[ends - 1] = rows[ends - 2] = len(coded) * buckets  # n-grams that would reach into the next text are counted nowhere
    mask, out = np.uint32(buckets - 1), np.zeros((len(coded) + 1) * buckets, np.float32)
    one, two = data[:-2] + np.uint32(1), data[1:-1] + np.uint32(1)
    bi = one * np.uint32(0x101) + two
    tri = bi * np.uint32(0x101) + data[2:] + np.uint32(1)
    for n, h in ((1, one), (2, bi), (3, tri)):
        h = (h + np.uint32(n)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        out += np.bincount(rows[:-2] + (h & mask), minlength=len(out))
    return out[: len(coded) * buckets].reshape(len(coded), buckets)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    floors: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Nearest language, cosine, and whether the distance rejects it; texts must have a letter."""
        vectors = unit(np.log1p(counts(texts, len(self.idf))) * self.idf)
        cosines = vectors @ self.centroids.T
        best = cosines.argmax(axis=1)
        top = np.clip(cosines[np.arange(len(texts)), best], 0, 1)
        return [self.langs[b] for b in best], top, top < self.floors[best]


def _kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; the same for the same rows."""
    seeds = [0]
    while len(seeds) < min(k, len(x)):
        seeds.append(int((x @ x[seeds].T).max(axis=1).argmin()))
    centres = x[seeds]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        centres = unit(np.stack([x[own == i].sum(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))]))
    return centres


def _slices(texts: list[str], rows: int = 256, size: int = 1 << 20):
    at = 0
    while at < len(texts):
        to, total = at, 0
        while to < len(texts) and to - at < rows and (to == at or total < size):
            total += len(texts[to])
            to += 1
        yield at, texts[at:to]
        at = to


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _document_frequencies(buckets: int):
    def run(batches):
        import pyarrow as pa

        total, rows = np.zeros(buckets, np.int64), 0
        for batch in batches:
            for _, texts in _slices(batch.column(0).to_pylist()):
                total += (counts(texts, buckets) > 0).sum(axis=0)
                rows += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets + 1)), pa.array(np.append(total, rows))], ["bucket", "df"])

    return run


def _vectors(buckets: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [v.tobytes() for _, texts in _slices(batch.column(2).to_pylist()) for v in counts(texts, buckets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.binary())], ["lang", "rank", "v"])

    return run


def fit(train: DataFrame, buckets: int = 4096, per_language: int = 3, max_sample: int = 2048, reject_share: float = 0.001) -> Model | None:
    """train: doc_id, text, lang. None without usable rows."""
    train = train.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    dfs = {r.bucket: r.df for r in train.select("text").mapInArrow(_document_frequencies(buckets), "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()}
    n_docs = dfs.pop(buckets)
    idf = (np.log((1 + n_docs) / (1 + np.array([dfs[b] for b in range(buckets)]))) + 1).astype(np.float32)
    share = max(1, max_sample // len(sizes))
    # The rows of each language with the smallest hashes of id and text; rows that repeat both count once. A task sends `share` hashes of a
    # language at most, so a language that has nearly all rows is no load on one.
    ranked = train.select("lang", F.xxhash64("doc_id", "text").alias("rank"), "text")
    first = Window.partitionBy("lang").orderBy("rank")
    lowest = ranked.select("lang", "rank").withColumn("at", F.row_number().over(first)).where(F.col("at") <= share).groupBy("lang").agg(F.max("rank").alias("last")).collect()
    last = F.create_map(*[F.lit(x) for r in lowest for x in (r["lang"], r["last"])])
    sample = ranked.where(F.col("rank") <= F.element_at(last, F.col("lang"))).dropDuplicates(["lang", "rank"])
    sample = sample.mapInArrow(_vectors(buckets), "lang string, rank long, v binary").orderBy("lang", "rank").collect()
    if missing := set(sizes) - {r.lang for r in sample}:
        raise ValueError(f"no row was drawn for {sorted(missing)}")
    langs, centroids, floors = [], [], []
    for lang in sorted(sizes):
        rows = [np.frombuffer(r.v, np.float32) for r in sample if r.lang == lang][:share]
        if rows:
            x = unit(np.log1p(np.stack(rows)) * idf)
            centres = _kmeans(x, per_language)
            cosines = x @ centres.T
            own = cosines.argmax(axis=1)
            langs += [lang] * len(centres)
            centroids.append(centres)
            floors += [0.5 * float(np.quantile(cosines[own == i, i], reject_share)) if (own == i).any() else 0.0 for i in range(len(centres))]
    return Model(idf, np.concatenate(centroids).astype(np.float32), langs, np.array(floors)) if langs else None


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, nearest (language or und), score (cosine, 0 to 1), rejected, lang (und if rejected)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            nearest, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            usable = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            for at, part in _slices([texts[i] for i in usable]):
                langs, top, far = model.predict(part)
                rows = usable[at : at + len(part)]
                score[rows], rejected[rows] = top, far
                for i, lang in zip(rows, langs, strict=True):
                    nearest[i] = lang
            final = [UNKNOWN if r else x for x, r in zip(nearest, rejected, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nearest), pa.array(score), pa.array(rejected), pa.array(final, pa.string())], ["doc_id", "nearest", "score", "rejected", "lang"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, nearest string, score double, rejected boolean, lang string")
