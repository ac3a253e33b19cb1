"""Quality rules: the hashed n-gram log-likelihood ratio between a trusted-target and a raw-corpus multinomial, divided by the
number of n-grams, with one fixed threshold for every document.

DataFrame functions only. Word unigrams and bigrams are hashed into buckets; the raw multinomial counts every n-gram of every
document, the target multinomial those of the trusted documents (at most `max_trusted` ids, the smallest by hash: the only bound,
and only on labelled rows). Both become one array of log ratios. Its length grows with the corpus, unless `buckets` says otherwise:
256 times the cube root of the number of documents, to the next power of two, at least 2**14 (2**16 for 15 million documents, 2**20
for 50 billion), so that it stays small enough to send to every task.

Rows: a null or empty text has no words, all counts 0, score 0 and fails the base rules. A very long text is judged whole. Repeated
rows are judged alike; a score at the threshold passes. Null ids
are never trusted. Without trusted documents all ratios are 0 and the base rules alone decide. Extra columns pass through `assess`
unless they are named like one of its own, which it replaces."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import SPACES, whole, words

#: Nats per n-gram below the raw corpus at which a document is rejected.
THRESHOLD = -0.1
#: Everything but the symbols #*$%&|<>
SYMBOLS = r"[^#*$%&|<>]+"
OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def trusted_ids(labels: DataFrame, max_trusted: int = 50_000) -> DataFrame:
    """The ids of labels with quality 1 and not toxic, the `max_trusted` smallest by hash."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)


def bucket_count(n_docs: int) -> int:
    """How many buckets n-grams are hashed into, for a corpus of this size."""
    return 1 << max(14, math.ceil(math.log2(256 * max(1, n_docs) ** (1 / 3))))


def _hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def _next(runs: Column, hashes: Column, n: int) -> Column:
    """Hashes of all runs of n words, from those of n - 1 words and of single words."""
    count = F.greatest(F.size(hashes) - (n - 1), F.lit(0))
    return F.slice(F.zip_with(runs, F.slice(hashes, n, F.greatest(F.size(hashes), F.lit(1))), lambda a, b: F.xxhash64(a, b)), 1, count)


def _buckets(hashes: Column, pairs: Column, buckets: int) -> Column:
    return F.transform(F.concat(hashes, pairs), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int, id_col: str, text_col: str, prior: float = 2.0) -> list[float]:
    """ln of each bucket's target count over the count that its share of the raw corpus would give, `prior` added to both.
    trusted has at most max_trusted ids."""
    mark = F.broadcast(trusted.select(F.col("doc_id").alias("__trusted")))
    rows = docs.select(F.col(id_col).alias("__id"), _hashes(words(F.col(text_col))).alias("__h")).join(mark, F.col("__id") == F.col("__trusted"), "left")
    rows = rows.withColumn("__pairs", _next(F.col("__h"), F.col("__h"), 2))
    grams = rows.select(F.col("__trusted").isNotNull().cast("long").alias("t"), F.explode(_buckets(F.col("__h"), F.col("__pairs"), buckets)).alias("b"))
    counts = {r.b: (r.raw, r.target) for r in grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target")).collect()}
    raw, target = (sum(c[i] for c in counts.values()) for i in (0, 1))
    seen = ((b, *counts.get(b, (0, 0))) for b in range(buckets))
    return [math.log((t + prior) / (r * target / raw + prior)) if target else 0.0 for _, r, t in seen]


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with __h, __pairs (hashes of words and of pairs), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = whole(F.col(text_col))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = docs.drop(*OWN).withColumns({"__w": words(F.col(text_col)), "__lines": lines, "n_symbols": F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long")})
    out = out.withColumns({
        "n_words": F.size("__w").cast("long"), "word_chars": F.length(F.array_join("__w", "")).cast("long"), "__h": _hashes(F.col("__w")),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    }).withColumn("__pairs", _next(F.col("__h"), F.col("__h"), 2)).withColumn("__tri", _next(F.col("__pairs"), F.col("__h"), 3))
    # Only texts with a repeated window sort their windows; equal neighbours give the places of repeated ones.
    placed = F.transform("__tri", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    out = out.withColumn("__placed", F.when(F.size(F.array_distinct("__tri")) < F.size("__tri"), F.sort_array(placed)).otherwise(none))
    pairs = F.zip_with("__placed", F.slice("__placed", 2, F.greatest(F.size("__placed"), F.lit(1))), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("__at", F.array_distinct(F.flatten(pairs)))
    covered = F.array_distinct(F.flatten(F.transform("__at", lambda p: F.array(p, p + 1, p + 2))))
    out = out.withColumn("n_repeat_words", F.size(covered).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("__w", "__lines", "__tri", "__placed", "__at")


def assess(docs: DataFrame, trusted: DataFrame, buckets: int | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the base counts, base_failed, score (nats per n-gram) and kept."""
    buckets = buckets or bucket_count(docs.count())
    ratios = log_ratios(docs, trusted, buckets, id_col, text_col)
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    out = base_rules(docs, text_col)
    total = F.aggregate(_buckets(F.col("__h"), F.col("__pairs"), buckets), F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    n_grams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    out = out.withColumn("score", total / n_grams)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold))).drop("__h", "__pairs")


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that pass, with the columns of docs as they were, whatever their names.

    A filter on the verdict alone would be pushed below the projections that make it, and each use of each intermediate column would
    become a copy of its expression. The optimiser leaves a filter above a row number, so the verdict is computed once."""
    rows = docs.select(F.col(options.get("id_col", "doc_id")), F.col(options.get("text_col", "text")), F.struct("*").alias("__row"))
    judged = assess(rows, trusted_ids(labels), **options).select("__row", "kept", F.monotonically_increasing_id().alias("__number"))
    return judged.where("kept and __number >= 0").select("__row.*")
