"""BM25 over an inverted index of blocks, with an early cut that stays exact.

Documents lie in strips of about `STRIP` documents of like length; a block is what one term has in one strip: documents, counts, lengths and
the largest weight in it. The sum of a query's largest weights bounds the score of any document of a strip, so the best strips are
scored first, their k-th score is the bar, and strips whose bound lies below it are never read. No block is longer than a strip, so a
term that every document has is many rows of its own keys, not one hot one.

Scores are summed where the blocks of a strip meet: what is shuffled is the blocks of the asked terms, each with the queries that ask
for it, never a row for each query and document. Queries go in parts of about `PART`, so no group grows with their number.

Texts are tokenised once and the terms of a document are counted inside its row, before anything is shuffled."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions.batches import pieces
from caselens.functions.text import token_list, tokens
from caselens.plans.scratch import Scratch

# Fixed values of the ranking function.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K = 60
#: Documents of a strip; bounds get tighter and more numerous as it shrinks.
STRIP = 32
#: Queries that are scored together on one strip.
PART = 1024
#: Scores agree in nine places; bounds give way by more than that.
SLACK = 1e-8


@dataclass
class Index:
    blocks: DataFrame  # term, strip, bound, n, docs (array of docid, tf, dl)
    lengths: DataFrame  # docid, dl
    vocabulary: DataFrame  # term, df, cf
    stats: DataFrame  # n, avgdl

    @property
    def postings(self) -> DataFrame:
        """term, docid, tf."""
        return self.blocks.select("term", F.explode("docs").alias("d")).select("term", "d.docid", "d.tf")

    def write(self, path: str) -> None:
        """Blocks lie sorted by term, so that a reader skips the row groups of other terms."""
        self.blocks.repartitionByRange("term", "strip").sortWithinPartitions("term", "strip").write.parquet(f"{path}/blocks")
        for name in ("lengths", "vocabulary", "stats"):
            getattr(self, name).write.parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark, path: str) -> Index:
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in ("blocks", "lengths", "vocabulary", "stats")])


def _count(batches):
    """docid, dl, terms, tfs: the different terms of each text with their counts, held for one piece of a batch at a time."""
    import pyarrow as pa

    for batch in (piece for whole in batches for piece in pieces(whole)):
        counts = [Counter(token_list(text.as_py())) for text in batch.column(1)]
        ends = pa.array(np.cumsum([0] + [len(c) for c in counts]).astype(np.int32))
        terms = pa.ListArray.from_arrays(ends, pa.array(list(chain.from_iterable(counts)), pa.string()))
        tfs = pa.ListArray.from_arrays(ends, pa.array(list(chain.from_iterable(c.values() for c in counts)), pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.total() for c in counts], pa.int64()), terms, tfs], ["docid", "dl", "terms", "tfs"])


def _blocks(avgdl: float):
    """term, strip, bound, n, docs of rows that lie in order of their strip: strip, docid, dl, terms, tfs. A strip's rows are held until the
    next one begins."""

    def made(table):
        import pyarrow as pa

        batch = table.combine_chunks().to_batches()[0]
        strips, docids, dls, terms, tfs = batch.columns
        sizes = np.diff(terms.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        coded, strip, tf = terms.flatten().dictionary_encode(), strips.to_numpy(), tfs.flatten().to_numpy()
        place = np.append(0, np.cumsum(strip[1:] != strip[:-1]))[row] * max(len(coded.dictionary), 1) + coded.indices.to_numpy()
        order = np.argsort(place, kind="stable")
        place, row, tf = place[order], row[order], tf[order]
        if not len(row):
            return None
        head = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        dl = dls.to_numpy()[row]
        bound = np.nextafter(np.maximum.reduceat(weight(tf, dl, avgdl), head).astype(np.float32), np.float32(np.inf))
        docs = pa.StructArray.from_arrays([docids.take(pa.array(row)), pa.array(tf), pa.array(dl.astype(np.int32))], ["docid", "tf", "dl"])
        term = coded.dictionary.take(pa.array(place[head] % len(coded.dictionary))).cast(pa.string())
        ends = pa.array(np.append(head, len(row)).astype(np.int32))
        sizes = pa.array(np.diff(np.append(head, len(row))).astype(np.int32))
        return pa.RecordBatch.from_arrays([term, pa.array(strip[row[head]]), pa.array(bound), sizes, pa.ListArray.from_arrays(ends, docs)], ["term", "strip", "bound", "n", "docs"])

    def run(batches):
        import pyarrow as pa

        held = None
        for piece in (piece for batch in batches for piece in pieces(batch)):
            table = pa.Table.from_batches([piece])
            held = table if held is None else pa.concat_tables([held, table])
            strip = held["strip"].to_numpy()
            cut = int(np.flatnonzero(strip[1:] != strip[:-1])[-1]) + 1 if (strip[1:] != strip[:-1]).any() else 0
            if cut and (out := made(held.slice(0, cut))) is not None:
                yield out
            held = held.slice(cut)
        if held is not None and (out := made(held)) is not None:
            yield out

    return run


def weight(tf, dl, avgdl: float):
    """What a term adds to a score, but for its idf; of columns or arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / float(avgdl or 1)))


def _strips(lengths: DataFrame) -> tuple[Column, int, float | None]:
    """(strip of docid and dl, number of documents, their mean length). Documents of like length share strips, which keeps bounds tight;
    there are at most some 250 classes of length."""
    kind = F.floor(F.log2(F.col("dl") + 1) * 8)
    found = lengths.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl")).collect()
    n, strips = sum(r.n for r in found), F.lit(1)
    for r in found:
        strips = F.when(kind == r.kind, -(-r.n // STRIP)).otherwise(strips)
    return kind * F.lit(1 << 40) + F.pmod(F.xxhash64("docid"), strips), n, sum(r.dl for r in found) / n if n else None


def build_index(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch | None = None, parts: bool = False) -> Index:
    """docs: one row per document, or with `parts` one or more. Lengths count tokens with repeats; documents without tokens count for the
    mean. Whole documents travel to their strips as one row each; of documents in parts each term does."""
    spark, scratch = docs.sparkSession, scratch or Scratch(docs.sparkSession, "index")
    rows = docs.select(F.col(id_col).alias("docid"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["docid"].dataType.simpleString()
    counted = scratch.write(rows.mapInArrow(_count, f"docid {kind}, dl long, terms array<string>, tfs array<int>"), "counted")
    pairs = counted.select("docid", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("docid", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
    if parts:
        scratch.release()
        pairs = scratch.write(pairs.groupBy("docid", "term").agg(F.sum("tf").alias("tf")), "merged")
        lengths = scratch.write(counted.groupBy("docid").agg(F.sum("dl").alias("dl")), "lengths")
    else:
        lengths = scratch.write(counted.select("docid", "dl"), "lengths")
    words = scratch.write(pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), "vocabulary")
    strip, n, avgdl = _strips(lengths)
    if parts:
        doc = F.struct("docid", F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl")).alias("doc")
        each = pairs.join(lengths, "docid").select("term", strip.alias("strip"), doc, weight(F.col("tf"), F.col("dl"), avgdl).alias("weight"))
        # The least step up: a bound may be rounded, but never down.
        blocks = each.groupBy("term", "strip").agg((F.max("weight") * (1 + 1e-6)).cast("float").alias("bound"), F.count(F.lit(1)).cast("int").alias("n"), F.collect_list("doc").alias("docs"))
    else:
        dealt = counted.select(strip.alias("strip"), "docid", "dl", "terms", "tfs").repartition("strip").sortWithinPartitions("strip")
        blocks = dealt.mapInArrow(_blocks(avgdl), f"term string, strip long, bound float, n int, docs array<struct<docid:{kind},tf:int,dl:int>>")
    blocks = scratch.write(blocks, "blocks")
    scratch.drop("counted", "merged")
    scratch.release()
    return Index(blocks, lengths, words, spark.createDataFrame([(n, avgdl)], "n long, avgdl double"))


def query_terms(queries: DataFrame, vocabulary: DataFrame, max_terms: int = 32, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """query_id, term, df: of each query the known terms with the most weight, min(tf, 3) / log2(df + 2), ties by term."""
    counted = queries.select(F.col(id_col).alias("query_id"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighed = counted.join(vocabulary.select("term", "df"), "term").withColumn("weight", F.least("tf", F.lit(3)) / F.log2(F.col("df") + 2))
    heaviest = Window.partitionBy("query_id").orderBy(F.desc("weight"), "term")
    return weighed.withColumn("at", F.row_number().over(heaviest)).where(F.col("at") <= max_terms).select("query_id", "term", "df")


def top(scored: DataFrame, k: int, *order: Column | str, by: str = "query_id") -> DataFrame:
    """The first k rows of each group with their rank; every order ends in an id, so ranks are total."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


@dataclass
class Search:
    """One search: scores (query_id, docid, score) of every document that could be among the best k, and the strips that were read."""

    scores: DataFrame
    strips: DataFrame  # query_id, strip, bound, postings, read


def _joined(table, name: str):
    """(row of the table, value) of each member of a list column."""
    import pyarrow.compute as pc

    lists = table[name].combine_chunks()
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), pc.list_flatten(lists)


def _bounds(key, table):
    """query_id, strip, part, bound, postings of one strip: the sums of the largest weights of each query's terms."""
    import pyarrow as pa

    row, asking = _joined(table, "queries")
    coded = asking.dictionary_encode()
    code, n = coded.indices.to_numpy(), len(coded.dictionary)
    bound = np.bincount(code, table["bound"].to_numpy()[row], n)
    postings = np.bincount(code, table["n"].to_numpy()[row], n).astype(np.int64)
    strip, part = (pa.array(np.full(n, k.as_py())) for k in key)
    return pa.Table.from_arrays([coded.dictionary, strip, part, pa.array(bound), pa.array(postings)], ["query_id", "strip", "part", "bound", "postings"])


def _scored(avgdl: float):
    """query_id, docid, score of the documents of one strip that reach the bar of a query that reads the strip."""

    def run(blocks, reads):
        import pyarrow as pa
        import pyarrow.compute as pc

        asks = reads["query_id"].combine_chunks()
        row, asking = _joined(blocks, "queries")
        query = pc.index_in(asking, value_set=asks)
        row, query = row[query.is_valid().to_numpy(zero_copy_only=False)], query.drop_null().to_numpy()
        at, docids = _joined(blocks, "docid")
        docs = docids.dictionary_encode(null_encoding="encode")
        tf, dl = _joined(blocks, "tf")[1].to_numpy(), _joined(blocks, "dl")[1].to_numpy()
        share = blocks["idf"].to_numpy()[at] * weight(tf, dl, avgdl)
        # Each asking query meets each document of its block.
        sizes = np.bincount(at, minlength=blocks.num_rows)
        each = sizes[row]
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat((np.cumsum(sizes) - sizes)[row], each)
        width = len(docs.dictionary)
        cell = np.repeat(query, each).astype(np.int64) * width + docs.indices.to_numpy()[place]
        sums = np.bincount(cell, share[place], len(asks) * width)
        bars = np.repeat(reads["bar"].fill_null(0).to_numpy(), width)
        cell = np.flatnonzero((sums > 0) & (sums >= bars - SLACK))
        return pa.Table.from_arrays([asks.take(pa.array(cell // width)), docs.dictionary.take(pa.array(cell % width)), pa.array(-sums[cell])], ["query_id", "docid", "score"])

    return run


def _searched(queries: DataFrame, index: Index, k: int, max_terms: int, id_col: str, text_col: str, allowed) -> Search:
    scratch = Scratch(queries.sparkSession, "bm25")
    n, avgdl = index.stats.first()
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = query_terms(queries.where(F.col(id_col).isNotNull()), index.vocabulary, max_terms, id_col, text_col)
    terms = scratch.write(terms.select("query_id", "term", F.when(idf <= 0, IDF_FLOOR).otherwise(idf).alias("idf")), "terms")
    parts = max(1, -(-terms.select("query_id").distinct().count() // PART))
    asked = terms.groupBy("term", F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part")).agg(F.first("idf").alias("idf"), F.collect_list("query_id").alias("queries"))
    asked = scratch.write(asked, "asked")
    kind, docs = terms.schema["query_id"].dataType.simpleString(), index.blocks.schema["docs"].dataType.elementType

    held = index.blocks.select("term", "strip", "bound", "n").join(asked, "term").select("strip", "part", (F.col("idf") * F.col("bound")).alias("bound"), "n", "queries")
    bounds = held.groupBy("strip", "part").applyInArrow(_bounds, f"query_id {kind}, strip long, part long, bound double, postings long")
    bounds = scratch.write(bounds, "bounds")
    scratch.release()

    def score(reads: DataFrame, name: str) -> DataFrame:
        found = index.blocks.select("term", "strip", F.col("docs.docid").alias("docid"), F.col("docs.tf").alias("tf"), F.col("docs.dl").alias("dl")).join(asked, "term")
        found = found.drop("term").join(reads.select("strip", "part").distinct(), ["strip", "part"], "left_semi")
        scores = found.groupBy("strip", "part").cogroup(reads.groupBy("strip", "part")).applyInArrow(_scored(avgdl), f"query_id {kind}, docid {docs['docid'].dataType.simpleString()}, score double")
        scores = scratch.write(scores if allowed is None else allowed(scores), name)
        scratch.release()
        return scores

    # The best strips set the bar, then everything that reaches it is read.
    first = scratch.write(top(bounds, k, F.desc("bound"), "strip").withColumn("bar", F.lit(None).cast("double")), "best")
    scores = score(first, "first")
    bar = top(scores, k, "score").groupBy("query_id").agg(F.count(F.lit(1)).alias("m"), (-F.max("score")).alias("bar")).where(F.col("m") == k)
    last = first.where(F.col("rank") == k).select("query_id", F.col("bound").alias("last_bound"), F.col("strip").alias("last_strip"))
    rest = bounds.join(last, "query_id").where((F.col("bound") < F.col("last_bound")) | ((F.col("bound") == F.col("last_bound")) & (F.col("strip") > F.col("last_strip"))))
    rest = rest.join(bar.select("query_id", "bar"), "query_id", "left").where(F.col("bar").isNull() | (F.col("bound") >= F.col("bar") - SLACK))
    rest = scratch.write(rest.select("query_id", "strip", "part", "bar"), "rest")
    scores, read = scores.unionByName(score(rest, "scores")), first.select("query_id", "strip").unionByName(rest.select("query_id", "strip"))
    return Search(scores, bounds.join(read.withColumn("read", F.lit(True)), ["query_id", "strip"], "left").withColumn("read", F.coalesce("read", F.lit(False))))


def bm25(queries: DataFrame, index: Index, k: int = 50, max_terms: int = 32, allowed: DataFrame | None = None, id_col: str = "query_id", text_col: str = "query", sources: DataFrame | None = None, filed: DataFrame | None = None) -> DataFrame:
    """query_id, docid, score (more negative is better), rank. Ties are broken by docid, or by source_id where sources (docid, source_id)
    has them; scores that agree in nine places count as equal, since the order of a distributed sum is not fixed.

    allowed filters before the cut, not after it: (query_id, docid), or with filed (docid, area) the areas of each query (query_id, area),
    so that a pool needs no row for each of its documents."""
    by_area = lambda found: found.join(filed, "docid").join(allowed, ["query_id", "area"], "left_semi").drop("area")
    by_id = lambda found: found.join(allowed, ["query_id", "docid"], "left_semi")
    scored = _searched(queries, index, k, max_terms, id_col, text_col, None if allowed is None else by_id if filed is None else by_area).scores
    if sources is None:
        return top(scored, k, F.round("score", 9), "docid")
    return top(scored.join(sources.select("docid", "source_id"), "docid"), k, F.round("score", 9), "source_id").drop("source_id")


def postings_read(queries: DataFrame, index: Index, k: int = 50, max_terms: int = 32, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """query_id, postings (those of its terms), read (those that a search for k documents scores)."""
    strips = _searched(queries, index, k, max_terms, id_col, text_col, None).strips
    return strips.groupBy("query_id").agg(F.sum("postings").alias("postings"), F.sum(F.when(F.col("read"), F.col("postings")).otherwise(0)).alias("read"))


def titles(citations: DataFrame) -> DataFrame:
    """knowledge_id, title: all labels of an entry, in order, one a line. citations: knowledge_id, label."""
    return citations.distinct().groupBy("knowledge_id").agg(F.array_join(F.array_sort(F.collect_list("label")), "\n").alias("title"))
