"""MinHash near-dedup: bottom-k sketches from one hash function; inverted lists of retained values generate overlaps; the sketch of
the union estimates the similarity and filters; exact Jaccard on full shingle sets verifies.

What is linked: documents whose shingle sets meet 100 * |A n B| >= percent * |A u B|. Results are the connected components of
those links.

1. One pass makes each document's set of 64-bit shingle hashes, its size, a 128-bit digest of the whole set and the k smallest
   hashes (all of them, if there are no more). Documents of one set are one node from here on; copies never meet in pairs.
2. Two linked sets share at least `overlap` of their retained values: a share that follows exactly from their sizes when both are
   retained whole, and six standard deviations below the expected share when one is cut at k. So they share one of the
   (retained - overlap + 1) rarest values of each. Only those enter the inverted lists, and only if another sketch has them too:
   frequent shingles stay out of the lists, without any cap on a list. This is done twice: sketches of `k` values find the documents
   that can have a partner at all, and sketches of `wide` values of those documents alone, whole for nearly all, make the lists.
3. A value's place among the rarest bounds the overlap from above (rarer values, foremost those nobody else has, are not shared before
   it). Entries that cannot reach any partner of their list go, and pairs that cannot reach the overlap are never formed.
4. Lists are worked off in rounds. In the first two, each node is paired with one leader of its lists; verified pairs join
   components. The last round pairs whatever still lies in one list but not in one component, each node outside the list's
   largest component with every node of other components, so no link between components is lost and large groups never meet in
   all pairs.

Rows: null and empty texts have the empty set and are linked with nothing. Texts of fewer than n words have their whole sequence as
one shingle. A very long text is read whole, in a slice of its own. Rows with a null id are linked with nothing, have a null
component and stay. Links follow the texts, not the ids: two rows of one id and different texts lie in the components of their texts. A
document is an id with a text; rows that repeat both are one document. Of a component the smallest id is kept; `near_dedup` keeps
one document there, of several texts of that id the one with the smallest hash. Empty tables give empty results. Extra columns,
whatever their names, pass through `near_dedup` and never reach `near_components`.

Misses: without `exact`, a link between sets cut at `k` (or at 1,024) values is missed when its sketches share fewer values than six
standard deviations below what is expected, about 4e-8 for a pair exactly at the threshold and less for others. With `exact` all
sets are whole in every step and no link is missed.

Work: pairs are formed only between sizes and places that allow the overlap. Of one list's nodes that are no links of each other but
could be by size and place (families just below the threshold) all pairs are checked; their number grows with the square of such a
family. Joins on values meet written aggregates, so that adaptive execution splits a hot value."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import Scratch, gram_hashes, mix, text_slices, whole, word_hashes
from caselens.operators.graph import connected_components

K = 64
WIDE = 1024
#: No sketch is cut at this size.
WHOLE = 1 << 30
#: Standard deviations between the expected and the demanded overlap of sketches that are cut.
ROOM = 6


def shingle_sets(column, n: int, lower: bool):
    """The sorted distinct 63-bit shingle hashes of each text of an Arrow string column."""
    for _, offsets, data in text_slices(column):
        hashes, first, _, _ = word_hashes(offsets, data, lower)
        grams = gram_hashes(hashes, n, n) >> np.uint64(1)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield gram_hashes(hashes[a:b], int(b - a), int(100 + b - a)) >> np.uint64(1)
            else:
                yield np.zeros(0, np.uint64)


def set_digest(values: np.ndarray) -> bytes:
    """128 bits of a set of hashes, the same in any order."""
    return np.array([mix(values).sum(dtype=np.uint64), mix(values ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)], np.uint64).tobytes()


def _sketcher(n: int, lower: bool, k: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sizes, digests, sketches = [], [], []
            for values in shingle_sets(batch.column(1), n, lower):
                sizes.append(len(values))
                digests.append(set_digest(values))
                sketches.append(values[:k])
            ends = np.cumsum([0] + [len(s) for s in sketches]).astype(np.int32)
            flat = np.concatenate(sketches).astype(np.int64) if sketches else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                ["doc_id", "th", "n", "digest", "sketch"],
            )

    return run


def _wide_sketcher(n: int, lower: bool, k: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sketches = [v[:k] for v in shingle_sets(batch.column(1), n, lower)]
            ends = np.cumsum([0] + [len(s) for s in sketches]).astype(np.int32)
            flat = np.concatenate(sketches).astype(np.int64) if sketches else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["node", "sketch"])

    return run


def _verifier(n: int, lower: bool, percent: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = pa.concat_arrays([part.column(2), part.column(3)]).dictionary_encode()
                sets = list(shingle_sets(texts.dictionary, n, lower))
                at = texts.indices.to_pylist()
                for j in range(part.num_rows):
                    a, b = sets[at[j]], sets[at[part.num_rows + j]]
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(common > 0 and 100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Links:
    """The linking of one table."""

    def __init__(self, docs: DataFrame, n: int, percent: int, lower: bool, k: int, id_col: str, text_col: str, exact: bool = False):
        self.n, self.percent, self.lower, self.k, self.wide_k, self.exact = n, percent, lower, k, WHOLE if exact else WIDE, exact
        self.scratch = Scratch(docs.sparkSession, "near")
        self.docs = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("text"), F.xxhash64(whole(F.col(text_col))).alias("th"))
        kind = self.docs.schema["doc_id"].dataType.simpleString()
        made = self.docs.mapInArrow(_sketcher(n, lower, k), f"doc_id {kind}, th long, n long, digest binary, sketch array<bigint>")
        self.sets = self.scratch.write(made, "sets")

    def room(self, k: int) -> float:
        share = self.percent / 100
        return ROOM * math.sqrt(share * (1 - share) * k)

    def needed(self, k: int, one, two):
        """How many values linked sets of these sizes share at least in their sketches."""
        share = self.percent / (100 + self.percent)
        return F.when(F.greatest(one, two) <= k, share * (one + two) - 1e-6).otherwise(k * share * (1 + F.least(one, two) / F.greatest(one, two)) - self.room(k))

    def rarest(self, sketches: DataFrame, k: int, name: str) -> DataFrame:
        """v, node, n, left: the rarest values of each sketch that others have too; left: how many of its values come no earlier.
        sketches: node, n, sketch (at most k values)."""
        values = sketches.select("node", F.explode("sketch").alias("v"))
        often = self.scratch.write(values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), f"often-{name}")
        shared = values.join(often, "v").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("own")).join(sketches.select("node", "n"), "node")
        # A set of n may have to share no more than percent of n, with the smallest partner; where that can be cut, less.
        least = F.ceil(F.col("n") * self.percent / 100)
        overlap = F.when(F.col("n") <= int(self.percent / 100 * k), least).otherwise(F.least(least, F.lit(int(self.percent / 100 * k - self.room(k)))))
        # Values nobody else has are the rarest and come first: they use up places without entering a list.
        take = (F.size("own") - overlap + 1).cast("int")
        posts = shared.withColumn("take", take).where("take > 0").select("node", "n", F.size("own").alias("m"), F.posexplode(F.slice("own", 1, F.col("take"))).alias("at", "p"))
        return posts.select(F.col("p.v").alias("v"), "node", "n", (F.col("m") - F.col("at")).alias("left"))

    def crowded(self, posts: DataFrame, k: int, name: str) -> DataFrame:
        """posts without those that can reach no size that occurs in their list, and without lists of one."""
        sizes = posts.groupBy("v").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("m")).where("m > 1").select("v", "low", "high")
        sizes = self.scratch.write(sizes, f"sizes-{name}")
        share = self.percent / 100
        small, large = F.greatest(F.col("low").cast("double"), F.col("n") * share), F.least(F.col("high").cast("double"), F.col("n") / share)
        reach = F.least(self.needed(k, F.col("n"), small), self.needed(k, F.col("n"), large)) <= F.col("left")
        return posts.join(sizes, "v").where(reach).drop("low", "high")

    def lists(self) -> None:
        """nodes: node, digest, n, doc_id, th (of one document). posts: v, node, n, c (class of n), left. wide: node, n, sketch."""
        usable = self.sets.where("doc_id is not null and n > 0")
        one = F.min_by(F.struct("doc_id", "th", "sketch"), F.struct("doc_id", "th")).alias("one")
        nodes = usable.groupBy("digest", "n").agg(one).select(F.monotonically_increasing_id().alias("node"), "digest", "n", "one.*")
        self.nodes = self.scratch.write(nodes, "nodes")
        if self.exact:
            wanted = self.nodes.select("node", "doc_id", "th")
        else:
            first = self.scratch.write(self.rarest(self.nodes.select("node", "n", "sketch"), self.k, "first"), "first-posts")
            wanted = self.crowded(first, self.k, "first").select("node").distinct().join(self.nodes.select("node", "doc_id", "th"), "node")
        texts = self.docs.where("doc_id is not null").join(wanted, ["doc_id", "th"]).groupBy("node").agg(F.first("text").alias("text"))
        self.texts = self.scratch.write(texts, "texts")
        self.scratch.drop("first-posts", "often-first", "sizes-first")
        self.scratch.release()
        wide = self.texts.mapInArrow(_wide_sketcher(self.n, self.lower, self.wide_k), "node long, sketch array<bigint>")
        self.wide = self.scratch.write(wide.join(self.nodes.select("node", "n"), "node").select("node", "n", "sketch"), "wide")
        posts = self.scratch.write(self.rarest(self.wide, self.wide_k, "second"), "second-posts")
        posts = self.scratch.write(self.crowded(posts, self.wide_k, "second"), "third-posts")
        size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / self.percent)).cast("int")
        self.posts = self.scratch.write(self.crowded(posts, self.wide_k, "third").withColumn("c", size_class), "posts")
        self.scratch.drop("second-posts", "third-posts", "often-second", "sizes-second", "sizes-third")
        self.scratch.release()

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The distinct pairs (a, b) that pass the estimate and then the exact check."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        side = lambda x: self.wide.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        # The smallest of the union; sketches that hold their whole sets give the similarity itself, others get six standard errors.
        union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, self.wide_k)
        both = both.withColumn("union", union)
        inside = F.size(F.array_intersect(F.array_intersect("union", "s_a"), F.col("s_b")))
        exact = F.size("s_a") + F.size("s_b") <= self.wide_k
        share = self.percent / 100
        fits = (100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b")) & (inside >= F.when(exact, share - 1e-9).otherwise(share - self.room(self.wide_k) / self.wide_k) * F.size("union"))
        likely = self.scratch.write(both.where(fits).select("a", "b"), f"{name}-likely")
        texts = likely.join(self.texts.withColumnRenamed("node", "a").withColumnRenamed("text", "ta"), "a")
        texts = texts.join(self.texts.withColumnRenamed("node", "b").withColumnRenamed("text", "tb"), "b").select("a", "b", "ta", "tb")
        out = self.scratch.write(texts.mapInArrow(_verifier(self.n, self.lower, self.percent), "a long, b long"), name)
        self.scratch.drop(f"{name}-likely")
        return out

    def labelled(self, labels: DataFrame | None) -> DataFrame:
        """posts with the component of each node: v, node, n, c, label."""
        if labels is None:
            return self.posts.withColumn("label", F.col("node"))
        return self.posts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def leaders(self, posts: DataFrame, seed: int) -> DataFrame:
        """Each node with two leaders of its lists and size classes that are of another component: one with the fewest values of its
        own, which is the likeliest to be linked with many, and one that a hash of this round picks."""
        chance = F.xxhash64(F.lit(seed), "node")
        head = lambda *first: F.min(F.struct(*first, F.col("node"), F.col("label"), F.col("n")))
        heads = posts.groupBy("v", "c").agg(head((F.col("n") - F.col("left")).alias("o"), chance.alias("p")).alias("head"), head(F.lit(0).cast("long").alias("o"), chance.alias("p")).alias("other"))
        heads = self.scratch.write(heads, f"heads-{seed}")
        # Sizes of linked sets are at most one class apart, so a list's leaders of both classes are tried.
        near = posts.select("v", "node", "n", "label", F.explode(F.array(F.col("c"), F.col("c") - 1)).alias("c"))
        met = near.join(heads, ["v", "c"])
        fits = lambda h: F.when((F.col("label") != F.col(f"{h}.label")) & (100 * F.least("n", f"{h}.n") >= self.percent * F.greatest("n", f"{h}.n")), F.col(h))
        best = met.groupBy("node").agg(F.min(fits("head")).alias("head"), F.min(fits("other")).alias("other"))
        return best.select(F.col("node").alias("a"), F.explode(F.array("head.node", "other.node")).alias("b")).where("b is not null")

    def rest(self, posts: DataFrame) -> DataFrame:
        """Pairs of one list and different components: nodes outside the list's largest component against all others."""
        sizes = posts.groupBy("v", "label").agg(F.count(F.lit(1)).alias("m"))
        largest = sizes.groupBy("v").agg(F.max(F.struct("m", "label")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("v", F.col("top.label").alias("top"))
        largest = self.scratch.write(largest, "largest")
        open_ = self.scratch.write(posts.join(largest, "v"), "open-posts")
        strays = open_.where("label <> top").select("v", F.col("node").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), F.col("left").alias("left_a"))
        fits = (F.col("la") != F.col("label")) & ((F.col("label") == F.col("top")) | (F.col("a") < F.col("node")))
        fits &= (100 * F.least("n", "na") >= self.percent * F.greatest("n", "na")) & (F.least("left", "left_a") >= self.needed(self.wide_k, F.col("n"), F.col("na")))
        return strays.join(open_, "v").where(fits).select("a", F.col("node").alias("b"))

    def components(self) -> DataFrame:
        """node, label of all nodes that are linked."""
        self.lists()
        edges, labels = None, None
        for i in range(3):
            posts = self.labelled(labels)
            pairs = self.rest(posts) if i == 2 else self.leaders(posts, i)
            found = self.verified(pairs, f"edges-{i}")
            edges = found if edges is None else edges.unionByName(found)
            labels = connected_components(edges, self.scratch, f"labels-{i}")
            self.scratch.drop(f"heads-{i}")
            self.scratch.release()
        self.scratch.drop("posts", "open-posts", "largest", "texts", "wide")
        return labels


def _judged(links: _Links) -> DataFrame:
    """One row per row of docs: doc_id, th, n, component (id), first (hash of the text that stands for that id there)."""
    labels = links.components()
    named = links.nodes.select("node", "digest", "n", F.struct("doc_id", "th").alias("least")).join(labels, "node", "left")
    named = links.scratch.write(named.withColumn("label", F.coalesce("label", "node")), "named")
    smallest = links.scratch.write(named.groupBy("label").agg(F.min("least").alias("least")), "smallest")
    of_set = links.scratch.write(named.drop("least").join(smallest, "label").select("digest", "n", "least"), "of-set")
    links.scratch.drop("named", "smallest")
    sets = links.sets.select("doc_id", "th", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    least = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", F.struct("doc_id", "th")))
    out = sets.join(of_set, ["digest", "n"], "left").withColumn("least", least)
    return out.select("doc_id", "th", "n", F.col("least.doc_id").alias("component"), F.col("least.th").alias("first"))


def near_components(
    docs: DataFrame, n: int = 5, percent: int = 80, lower: bool = True, k: int = K, id_col: str = "doc_id", text_col: str = "text", exact: bool = False
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest id of the component), kept (the row of that id)."""
    out = _judged(_Links(docs, n, percent, lower, k, id_col, text_col, exact))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def near_dedup(
    docs: DataFrame, n: int = 5, percent: int = 80, lower: bool = True, k: int = K, id_col: str = "doc_id", text_col: str = "text", exact: bool = False
) -> DataFrame:
    """docs with one document of each component, with all columns as they were; rows with a null id or the empty set stay."""
    judged = _judged(_Links(docs, n, percent, lower, k, id_col, text_col, exact))
    gone = judged.where("doc_id <> component or th <> first").select("doc_id", "th").distinct()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(whole(F.col(text_col))).alias("th"), F.struct("*").alias("row"))
    return rows.join(gone, ["doc_id", "th"], "left_anti").select("row.*")
