"""Substring dedup with a log-structured fingerprint index: sorted immutable runs of window hashes, merge-joined with each new batch,
verified on whole windows, then compacted.

What is removed: every word covered by a window of `window` consecutive words of one document whose words also stand in a row
anywhere else, in the same document too. Windows are judged on the input, not on what is left of it.

Fingerprints: of the runs of `gram` words inside a window the one with the smallest hash stands for the window (the leftmost, if
equal). Equal windows have equal fingerprints at equal places, so a window can only repeat if its fingerprint does. About one word
in fourteen is a fingerprint; the index holds a count for each hash, not a row for each window.

1. One pass hashes all words of all texts and writes each document's fingerprints with their places.
2. Each batch becomes a run: its hashes with counts, sorted. The run is merge-joined with the compacted history (an outer join on the
   hash) and the sum is the next history. Documents of earlier batches see the counts of later ones, as every window counts.
3. Verification: documents with a repeated fingerprint hash the whole windows that it stands for. Only windows that agree in
   fingerprint and in the hash over all their words count as equal. Both are made from 64-bit hashes of the words, so two different
   words of one hash would pass for the same; among d distinct words that has a chance of about d * d / 2**65. Fingerprints whose windows are all the same
   as another's collapse into one counted context first; windows are told apart, by counts, only under fingerprints with several
   contexts. A passage in a third of all documents meets as partial counts, never as rows of one task.

All of this judges one table. `WindowHistory` is for tables that come in batches: it keeps the hashes of all windows of earlier
batches in sorted immutable runs, joins each new batch with them, and compacts them when asked to.

Rows: null, empty and short texts have no windows and lose nothing. Null ids and rows that repeat an id are documents of their own, told
apart by text; wholly repeated rows are copies of each other and lose all their windows. A very long text is one slice and is read
whole (up to 2**28 words in a slice; more are an error). Empty tables give an empty result. Extra columns, whatever their names,
pass through `remove_repeats` and never reach `repeats`."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import Scratch, delete, gram_hashes, mix, text_slices, whole, word_hashes

PLACE_BITS = np.uint64(28)


def fingerprint_places(hashes: np.ndarray, first: np.ndarray, window: int, gram: int):
    """(starts of all windows of each row, place of the fingerprint of each, gram hashes), over the words of a slice."""
    if len(hashes) >> int(PLACE_BITS):
        raise ValueError("too many words in one slice")
    starts = [np.arange(a, b - window + 1) for a, b in zip(first[:-1], first[1:], strict=True) if b - a >= window]
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.concatenate(starts)
    grams = gram_hashes(hashes, gram, 11)
    # The place in the low bits makes the minimum leftmost and tells where it is.
    keyed = (grams >> PLACE_BITS << PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    span, have, least = window - gram + 1, 1, keyed
    while 2 * have <= span:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    return starts, (least[starts] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64), grams


def _distinct_runs(places: np.ndarray) -> np.ndarray:
    """Indices where a new fingerprint begins; a fingerprint's windows stand side by side."""
    fresh = np.ones(len(places), bool)
    fresh[1:] = places[1:] != places[:-1]
    return np.flatnonzero(fresh)


def _fingerprinter(window: int, gram: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sizes, digests, counts, places, values = [], [], [], [], []
            for _, offsets, data in text_slices(batch.column(2)):
                raw = data.tobytes()
                hashes, first, _, _ = word_hashes(offsets, data)
                _, place, grams = fingerprint_places(hashes, first, window, gram)
                own = place[_distinct_runs(place)] if len(place) else place
                row = np.searchsorted(first, own, "right") - 1
                sizes.append(np.diff(first))
                counts.append(np.bincount(row, minlength=len(first) - 1))
                places.append((own - first[row]).astype(np.int32))
                values.append(grams[own].view(np.int64) if len(own) else np.zeros(0, np.int64))
                digests += [hashlib.sha256(b" ".join(raw[a:b].split())).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            if not sizes:
                continue
            ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(places))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values)))],
                ["doc_id", "th", "n_words", "sha", "place", "h"],
            )

    return run


def _context(windows: np.ndarray, head: np.ndarray) -> np.ndarray:
    """One 64-bit hash for the list of windows of each fingerprint."""
    place = np.arange(len(windows)) - np.repeat(head, np.diff(np.append(head, len(windows))))
    return mix(np.add.reduceat(mix(windows + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), head)).view(np.int64)


def _marked_fingerprints(batch, window: int, gram: int):
    """For each slice of texts: (row of the batch, index of its fingerprint among the heads, and what both sides need)."""
    wanted = batch.column(3)
    for at, offsets, data in text_slices(batch.column(2)):
        hashes, first, _, _ = word_hashes(offsets, data)
        starts, place, grams = fingerprint_places(hashes, first, window, gram)
        if not len(starts):
            continue
        head = _distinct_runs(place)
        row = np.searchsorted(first, place[head], "right") - 1
        part = wanted.slice(at, len(first) - 1)
        marked = np.zeros(len(hashes), bool)
        marked[part.flatten().to_numpy(zero_copy_only=False) + np.repeat(first[:-1], part.value_lengths().to_numpy(zero_copy_only=False))] = True
        windows = gram_hashes(hashes, window, 23)[starts]
        use = np.flatnonzero(marked[place[head]])
        if len(use):
            yield row[use] + at, use, head, windows, starts - np.repeat(first[row], np.diff(np.append(head, len(place)))), place[head] - first[row], grams[place[head]].view(np.int64)


def _context_hasher(window: int, gram: int):
    """For each wanted fingerprint: its hash, the hash of all its windows, its place, its first window and their number."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for rows, use, head, windows, starts, places, grams in _marked_fingerprints(batch, window, gram):
                rows, size = pa.array(rows), np.diff(np.append(head, len(windows)))
                columns = [grams[use], _context(windows, head)[use], places[use].astype(np.int32), starts[head[use]].astype(np.int32), size[use].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *map(pa.array, columns)], ["doc_id", "th", "h", "g", "place", "first", "size"])

    return run


def _window_lister(window: int, gram: int):
    """For each wanted fingerprint: its hash, the hash of all its windows, and their hashes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for _, use, head, windows, _, _, grams in _marked_fingerprints(batch, window, gram):
                foot = np.append(head[1:], len(windows))
                lists = [windows[head[i] : foot[i]] for i in use]
                ends = pa.array(np.cumsum([0] + [len(x) for x in lists]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(grams[use]), pa.array(_context(windows, head)[use]), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists).view(np.int64)))], ["h", "g", "windows"])

    return run


def _remover(window: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            removed, kept = [], []
            for text, marks in zip(batch.column(2).cast(pa.large_binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = text.split()
                edges = np.zeros(len(words) + 1, np.int32)
                for m in marks:
                    at = m["first"] + np.flatnonzero([m["mask"] >> i & 1 for i in range(m["mask"].bit_length())])
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + window, -1)
                gone = np.cumsum(edges[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone, strict=True) if not g]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "th", "n_removed", "kept"])

    return run


class FingerprintIndex:
    """Counts of fingerprint hashes in one compacted run, sorted by hash; a new batch is merge-joined into the next run."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.run, self.number = scratch, None, 0

    def add(self, hashes: DataFrame) -> None:
        """hashes: h, a row for each fingerprint of a batch."""
        batch = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        if self.run is not None:
            batch = self.run.withColumnRenamed("n", "old").join(batch, "h", "full_outer").select("h", (F.coalesce("old", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"))
        self.number += 1
        self.run = self.scratch.write(batch.sortWithinPartitions("h"), f"run-{self.number}")
        self.scratch.drop(f"run-{self.number - 1}")

    def repeated(self) -> DataFrame:
        return self.run.where("n > 1").select("h")

    def close(self) -> None:
        """Drops the index; every call builds it anew."""
        self.scratch.drop(f"run-{self.number}")


def repeats(docs: DataFrame, window: int = 35, gram: int = 8, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(one row per row of docs: doc_id, th, n_words, sha of its words joined by a space; one row per document that loses words:
    doc_id, th, n_removed, kept). th is a hash of the text; window - gram must be below 31."""
    if not 0 < gram <= window or window - gram > 30:
        raise ValueError("the windows of a fingerprint must fit into 31 bits")
    scratch = Scratch(docs.sparkSession, "substring")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(whole(F.col(text_col))).alias("th"), whole(F.col(text_col)).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    made = slim.mapInArrow(_fingerprinter(window, gram), f"doc_id {kind}, th long, n_words long, sha binary, place array<int>, h array<bigint>")
    made = scratch.write(made, "documents")
    index = FingerprintIndex(scratch)
    part = F.pmod(F.xxhash64("th", "doc_id"), F.lit(batches))
    for b in range(batches):
        index.add(made.where(part == b).select(F.explode("h").alias("h")))
        scratch.release()

    # Documents with repeated fingerprints, and where those are.
    found = made.select("doc_id", "th", F.explode(F.arrays_zip("place", "h")).alias("x")).select("doc_id", "th", "x.place", "x.h").join(index.repeated(), "h")
    wanted = scratch.write(found.groupBy("doc_id", "th").agg(F.collect_set("place").alias("places")), "wanted")
    same = lambda a, b: (F.col(f"{a}.th") == F.col(f"{b}.th")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
    some = slim.alias("a").join(wanted.alias("b"), same("a", "b")).select("a.doc_id", "a.th", "a.text", "b.places")
    some = scratch.write(some, "candidates")
    index.close()
    scratch.release()

    # Whole windows. Fingerprints with the same list of windows are one context, whose windows all repeat if it occurs twice.
    held = scratch.write(some.mapInArrow(_context_hasher(window, gram), f"doc_id {kind}, th long, h long, g long, place int, first int, size int"), "held")
    contexts = held.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.min(F.struct("th", "doc_id", "place")).alias("one"))
    contexts = scratch.write(contexts, "contexts")
    # Only fingerprints with several contexts need their windows told apart, from one document of each context.
    several = scratch.write(contexts.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h"), "several")
    mixed = scratch.write(contexts.join(several, "h", "left_semi"), "mixed")
    wanted = mixed.groupBy(F.col("one.doc_id").alias("doc_id"), F.col("one.th").alias("th")).agg(F.collect_set("one.place").alias("places"))
    again = some.select("doc_id", "th", "text").dropDuplicates(["doc_id", "th"]).alias("a").join(wanted.alias("b"), same("a", "b")).select("a.doc_id", "a.th", "a.text", "b.places")
    listed = scratch.write(again.mapInArrow(_window_lister(window, gram), "h long, g long, windows array<bigint>"), "listed")
    scratch.release()
    single = listed.dropDuplicates(["h", "g"]).join(mixed.select("h", "g", "n"), ["h", "g"]).select("h", "g", "n", F.posexplode("windows").alias("i", "w"))
    twice = single.groupBy("h", "w").agg(F.sum("n").alias("m")).where("m > 1").select("h", "w")
    twice = scratch.write(twice, "twice")
    masks = single.join(twice, ["h", "w"]).groupBy("h", "g").agg(F.expr("bit_or(shiftleft(1, i))").alias("mask"))
    whole_lists = contexts.where("n > 1").join(several, "h", "left_anti").select("h", "g", F.expr("cast(shiftleft(1L, size) - 1 as int)").alias("mask"))
    masks = scratch.write(masks.unionByName(whole_lists), "masks")
    scratch.drop("listed", "contexts", "mixed", "several", "twice", "wanted")
    scratch.release()
    marked = held.select("doc_id", "th", "h", "g", "first").join(masks, ["h", "g"]).groupBy("doc_id", "th").agg(F.collect_set(F.struct("first", "mask")).alias("marks"))
    marked = scratch.write(marked, "marked")
    scratch.drop("held", "masks")
    scratch.release()
    cut = some.select("doc_id", "th", "text").alias("a").join(marked.alias("b"), same("a", "b")).select("a.doc_id", "a.th", "a.text", "b.marks")
    cut = scratch.write(cut.mapInArrow(_remover(window), f"doc_id {kind}, th long, n_removed long, kept string"), "cut")
    scratch.drop("candidates", "marked")
    scratch.release()
    return made.select("doc_id", "th", "n_words", "sha"), cut.dropDuplicates(["doc_id", "th"])


def removal_digest(docs: DataFrame, window: int = 35, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256."""
    made, cut = repeats(docs, window, **options)
    cut = cut.select("doc_id", "th", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    on = (F.col("a.th") == F.col("b.th")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    return made.alias("a").join(cut.alias("b"), on, "left").select(
        "a.doc_id", "a.n_words", F.coalesce("b.n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("b.kept_sha256", F.lower(F.hex("a.sha"))).alias("kept_sha256")
    )


def _replaced(docs: DataFrame, cut: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with the texts that cut (doc_id, th, kept) holds, other columns as they were."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(whole(F.col(text_col))).alias("th"), F.struct("*").alias("row"))
    on = (F.col("a.th") == F.col("b.th")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    text = F.when(F.col("b.th").isNotNull(), F.col("b.kept")).otherwise(F.col("a.row")[text_col])
    columns = [text.alias(c) if c == text_col else F.col("a.row")[c].alias(c) for c in docs.columns]
    return rows.alias("a").join(cut.select("doc_id", "th", "kept").alias("b"), on, "left").select(*columns)


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the texts that lost words replaced by what is left, words joined by one space; other texts and columns as they were."""
    _, cut = repeats(docs, window, id_col=id_col, text_col=text_col, **options)
    return _replaced(docs, cut, id_col, text_col)


def _window_hasher(window: int):
    """128 bits of every window of each document, in order of place."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at, offsets, data in text_slices(batch.column(2)):
                hashes, first, _, _ = word_hashes(offsets, data)
                pairs = [gram_hashes(hashes, window, seed).view(np.int64) for seed in (23, 37)]
                sizes = np.maximum(np.diff(first) - window + 1, 0)
                heads = np.cumsum(sizes) - sizes
                take = np.arange(sizes.sum()) + np.repeat(first[:-1] - heads, sizes)
                ends = pa.array(np.append(heads, sizes.sum()).astype(np.int32))
                columns = [pa.ListArray.from_arrays(ends, pa.array(p[take] if len(take) else np.zeros(0, np.int64))) for p in pairs]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sizes)), batch.column(1).slice(at, len(sizes)), *columns], ["doc_id", "th", "w", "w2"])

    return run


class WindowHistory:
    """Removal of repeated passages from one batch after another, against all that came before.

    A folder of the caller's holds a run for each batch: the distinct 128-bit hashes of its windows, dealt by hash and sorted. `dedup` removes
    from a batch each word covered by a window that stands in an earlier batch or elsewhere in this one; windows are judged on the
    input, and earlier results stay as they are. `compact` merges the runs into one. A run that was not written to its end has no
    _SUCCESS file and is not read; writing it again replaces it.

    A batch that has a name can be run again, as after a write of its result that failed: its run is known by the name, is left out with
    all later ones, and is replaced, so the result is the same. Once its run is compacted it cannot be told from the others any more, and
    running the batch again is an error. Batches without a name are new each time."""

    def __init__(self, spark, folder: str, window: int = 35):
        self.spark, self.folder, self.window = spark, folder.rstrip("/"), window

    def _names(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        found = [f.getPath().getName() for f in system.listStatus(path) if f.isDirectory()]
        return sorted(n for n in found if n.startswith("run-") and system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS")))

    def _current(self) -> list[str]:
        """The runs that count: the last compacted one and those behind it."""
        names = self._names()
        merged = [n for n in names if n.endswith("-all")]
        return [n for n in names if not merged or n >= merged[-1]]

    def _next(self, tail: str = "") -> str:
        last = self._names()
        return f"run-{int(last[-1].split('-')[1]) + 1 if last else 0:06d}{tail}"

    def _run_of(self, batch: str | None) -> str | None:
        """The run that a named batch has left."""
        if batch is None:
            return None
        tag = hashlib.sha256(batch.encode()).hexdigest()[:24]
        if self._exists(f"merged-{tag}"):
            raise ValueError(f"batch {batch!r} is part of a compacted run")
        return next((n for n in self._names() if n.endswith(f"-{tag}")), self._next(f"-{tag}"))

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, before: str | None = None) -> DataFrame | None:
        names = [n for n in self._current() if before is None or n < before]
        return self.spark.read.schema("w long, w2 long").parquet(*[f"{self.folder}/{n}" for n in names]) if names else None

    def _write(self, windows: DataFrame, name: str) -> None:
        windows.repartition("w").sortWithinPartitions("w", "w2").write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def compact(self) -> None:
        """One run in place of all; the old ones are deleted once it is there."""
        old = self._current()
        if len(old) > 1:
            for name in old:  # first, so that no batch of a merged run is ever taken for a new one
                tag = name.split("-")[2] if name.count("-") > 1 else "all"
                if tag != "all":
                    path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/merged-{tag}")
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)
            self._write(self._read().distinct(), self._next("-all"))
        for name in set(self._names()) - set(self._current()):
            delete(self.spark, f"{self.folder}/{name}")

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """docs of a new batch with the texts that lost words replaced by what is left; its windows enter the history. batch: its name."""
        run = self._run_of(batch)
        scratch = Scratch(self.spark, "history")
        slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(whole(F.col(text_col))).alias("th"), whole(F.col(text_col)).alias("text"))
        kind = slim.schema["doc_id"].dataType.simpleString()
        hashed = slim.mapInArrow(_window_hasher(self.window), f"doc_id {kind}, th long, w array<bigint>, w2 array<bigint>")
        placed = scratch.write(hashed.select("doc_id", "th", F.posexplode(F.arrays_zip("w", "w2")).alias("i", "x")).select("doc_id", "th", "i", "x.w", "x.w2"), "placed")
        counted = scratch.write(placed.groupBy("w", "w2").agg(F.count(F.lit(1)).alias("n")), "counted")
        known, again = self._read(run), counted.where("n > 1").select("w", "w2")
        if known is not None:
            again = again.unionByName(counted.where("n = 1").join(known, ["w", "w2"], "left_semi").select("w", "w2"))
        again = scratch.write(again, "again")
        marks = placed.join(again, ["w", "w2"]).groupBy("doc_id", "th").agg(F.collect_set(F.struct(F.col("i").alias("first"), F.lit(1).alias("mask"))).alias("marks"))
        marks = scratch.write(marks, "marks")
        self._write(counted.select("w", "w2"), run or self._next())
        same = (F.col("a.th") == F.col("b.th")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
        some = slim.alias("a").join(marks.alias("b"), same).select("a.doc_id", "a.th", "a.text", "b.marks").dropDuplicates(["doc_id", "th"])
        cut = scratch.write(some.mapInArrow(_remover(self.window), f"doc_id {kind}, th long, n_removed long, kept string"), "cut")
        scratch.drop("placed", "counted", "again", "marks")
        return _replaced(docs, cut, id_col, text_col)
