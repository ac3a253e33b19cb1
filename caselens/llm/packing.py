"""Best-fit packing under conflicts: residual-ordered bins carry a bitmap of their sources and one of their duplicate clusters; from
the smallest sufficient residual the successor search goes on until it finds the tightest bin that both bitmaps allow.

A bin holds at most `capacity` words. Two pieces conflict when they share a source or a duplicate cluster (equal texts). A document
longer than a bin is cut into full pieces, a bin each, and a rest that is packed like any short document; no word is lost.
Documents come longest first (best-fit decreasing), ties by id and hash.

Rows are dealt by hash into groups of about `group_rows`, packed side by side; a bin never spans groups, so memory is bounded by a
group and a hot source or cluster is spread over all of them. The number of groups follows the table. Rows that repeat both id
and text often, which one hash would bring together, are counted first and dealt by their number among those that are equal in all that
packing reads, so results do not depend on how the files lie.

Duplicate clusters are equal texts, or the values of `cluster_col` (near-duplicate components, say).

Rows: a null source conflicts with nothing (unknown sources are not one source); a null or empty text has no words, takes a place of
length 0 and still conflicts with its like. Null ids and repeated rows are packed as rows of their own. A very long text becomes
as many pieces as it takes. An empty table gives an empty result. Extra columns are not read."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import Scratch, whole, words

SCHEMA = "piece int, start_word long, n_words long, bin string, slot int, bin_words long"


class Bins:
    """Open bins by residual; on each level by source bitmap, so that a conflict of sources skips all bins of that bitmap at once."""

    def __init__(self, capacity: int):
        self.capacity, self.levels, self.at = capacity, [], {}
        self.used: list[int] = []
        self.count: list[int] = []

    def _enter(self, residual: int, sources: int, number: int, clusters: int) -> None:
        level = self.at.get(residual)
        if level is None:
            level = self.at[residual] = {}
            insort(self.levels, residual)
        level.setdefault(sources, {})[number] = clusters

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, slot) of a piece; source and cluster are single bits, or 0 where they conflict with nothing."""
        for i in range(bisect_left(self.levels, size), len(self.levels)):
            residual = self.levels[i]
            level = self.at[residual]
            for sources, bins in level.items():
                if sources & source:
                    continue
                number = next((n for n, clusters in bins.items() if not clusters & cluster), None)
                if number is None:
                    continue
                clusters = bins.pop(number)
                if not bins:
                    del level[sources]
                    if not level:
                        del self.at[residual]
                        self.levels.pop(i)
                self._enter(residual - size, sources | source, number, clusters | cluster)
                self.used[number] += size
                self.count[number] += 1
                return number, self.count[number] - 1
        return self.open(size, source, cluster)

    def open(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        number = len(self.used)
        self.used.append(size)
        self.count.append(1)
        self._enter(self.capacity - size, source, number, cluster)
        return number, 0


def pack_rows(rows: list[tuple], capacity: int) -> list[tuple]:
    """rows: (words, source or None, cluster). Returns (row, piece, start, words, bin, slot, words in the bin), packed in row order."""
    source_bits: dict = {}
    often: dict = {}
    for _, _, cluster in rows:
        often[cluster] = often.get(cluster, 0) + 1
    cluster_bits = {c: 1 << i for i, c in enumerate(c for c, n in often.items() if n > 1)}
    bins, out = Bins(capacity), []
    for i, (n, source, cluster) in enumerate(rows):
        bit = 0 if source is None else source_bits.setdefault(source, 1 << len(source_bits))
        group = cluster_bits.get(cluster, 0)
        start, piece = 0, 0
        while n - start > capacity:
            out.append((i, piece, start, capacity, *bins.open(capacity, bit, group)))
            start, piece = start + capacity, piece + 1
        out.append((i, piece, start, n - start, *bins.put(n - start, bit, group)))
    return [(*o, bins.used[o[4]]) for o in out]


#: Rows of one id and text beyond this number are spread.
REPEATS = 64


def pack(
    docs: DataFrame, capacity: int = 2048, group_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None
) -> DataFrame:
    """One row for each piece of each row of docs: doc_id, source, piece, start_word, n_words, bin, slot, bin_words."""
    text = whole(F.col(text_col))
    cluster = F.xxhash64(F.col(cluster_col) if cluster_col else text)
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.size(words(text)).cast("long").alias("n"), cluster.alias("cluster"),
        F.xxhash64(F.col(id_col), text).alias("key"),
    )
    groups = max(1, -(-docs.count() // group_rows))
    scratch = Scratch(docs.sparkSession, "packing")
    often = scratch.write(slim.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > REPEATS).select("key"), "often")
    dealt = slim.withColumn("grp", F.pmod("key", F.lit(groups)))
    if not often.isEmpty():
        equal = slim.join(often, "key", "left_semi").groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("m"))
        numbered = equal.withColumn("number", F.explode(F.sequence(F.lit(1), "m"))).drop("m")
        spread = numbered.withColumn("grp", F.pmod(F.xxhash64("key", "number"), F.lit(groups))).drop("number")
        dealt = dealt.join(often, "key", "left_anti").unionByName(spread)
    slim = dealt.drop("key")
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(key, table):
        import pyarrow as pa

        table = table.sort_by([("n", "descending"), ("doc_id", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
        ids, sources = table.column("doc_id"), table.column("source")
        packed = pack_rows(list(zip(table.column("n").to_pylist(), sources.to_pylist(), table.column("cluster").to_pylist(), strict=True)), capacity)
        rows, piece, start, n, bin_, slot, used = zip(*packed, strict=True)
        names = [f"{key[0].as_py()}-{b}" for b in bin_]
        return pa.Table.from_arrays(
            [ids.take(pa.array(rows)).combine_chunks(), sources.take(pa.array(rows)).combine_chunks(), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(names), pa.array(slot, pa.int32()), pa.array(used, pa.int64())],
            ["doc_id", "source", "piece", "start_word", "n_words", "bin", "slot", "bin_words"],
        )

    return slim.groupBy("grp").applyInArrow(run, f"doc_id {kind}, source string, {SCHEMA}")
