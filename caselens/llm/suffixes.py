"""Suffix-array dedup by bucket-pointer refinement: suffixes start in buckets of equal q-grams, and buckets are refined by the bucket
identifiers of later offsets, the refined identifiers being used again for the next step, until a bucket is one string of `window` bytes.

What is removed: every byte covered by a string of `window` bytes that also starts earlier, in a document with a smaller id or at a
smaller place of the same one. Strings are judged on the input, overlaps count, matches never cross documents.

Identifiers: the bucket of a suffix at depth 2d is told by its bucket at depth d and by the bucket of the suffix d bytes later, so the depth
doubles with each step (1, 2, 4, ... 32, 64, and 64 with the one 36 bytes later for 100). An identifier is a 64-bit hash of the two it is
made of, not a rank: tasks then agree on it without meeting. Numpy refines all suffixes of a block of bytes at once.

Only some suffixes travel. Of the 32-grams inside a string of 100 bytes the one with the smallest identifier stands for it (the leftmost, if
equal): an anchor, about every 35th place. Equal strings have equal anchors at equal places, so:

1. Buckets of anchors at depth 32 are counted. Those of one suffix are done, as in any refinement.
2. The others are refined by the identifiers, at depth 100, of all strings that the anchor stands for (its context). A bucket of one context
   is done: all but its first suffix repeat that.
3. Buckets of several contexts are refined to single strings: the first suffix of each context lists its strings with their identifiers at
   depth 100, 16 at most in a row; rows whose common 85 bytes stand nowhere else are done; of the other strings the first place is kept.

A string is told by its anchor's identifier and by its own, from two families of hashes: 128 bits for strings of different anchors, 64 for
strings that share their anchor.

A bucket that holds a third of all suffixes meets as partial counts and first places; its members are marked by a join with the written
buckets, which adaptive execution can split. Texts travel once more, those that lose bytes only.

Rows: null and short texts lose nothing. Null ids come after all others. Rows that repeat an id come in the order of their texts' sha-256;
wholly repeated rows are one document and lose the same bytes. Long texts are worked on in blocks, so
a text of any length needs some tens of megabytes beside itself. Empty tables give empty results; extra columns are not read by
`digest` and pass through `remove`. Where a removed run parts a sign of several bytes, `remove` shows what is left of it as U+FFFD."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import Scratch, mix, text_slices, whole

DEPTH = 32
SEGMENT = 16
#: Bits for the number of strings of a context behind their first start.
RUN = 20
BLOCK = 1 << 18
PLACE = np.uint64(20)
_LOW = (np.uint64(1) << PLACE) - np.uint64(1)


def refined(ids: np.ndarray, later: int, step: int, family: int) -> np.ndarray:
    """Identifiers of the suffixes from those at the same place and `later` bytes on; `later` fewer of them."""
    out = ids[: len(ids) - later] >> np.uint64(29)
    out ^= ids[: len(ids) - later]
    out *= mix(np.array([step * 2 + family * 1000 + 1], np.uint64))[0] | np.uint64(1)
    out += ids[later:]
    return out


def identifiers(data: np.ndarray, depth: int, family: int) -> np.ndarray:
    """The bucket of each suffix at this depth, by doubling; len(data) - depth + 1 of them."""
    ids, have = data.astype(np.uint64) + np.uint64(1), 1
    while have < depth and len(ids):
        later = min(have, depth - have)
        ids = refined(ids, min(later, len(ids)), have, family)
        have += later
    return mix(ids)


def anchors(ids: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Place of the anchor of each string: the leftmost smallest of the `span` identifiers from its start on."""
    keyed = (ids >> PLACE << PLACE) | np.arange(len(ids), dtype=np.uint64)
    have, least = 1, keyed
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return (least[starts] & _LOW).astype(np.int64)


def blocks(column, window: int):
    """(first row, first byte of it, offsets, bytes): whole rows, or a long row in parts that share window - 1 bytes."""
    for at, offsets, data in text_slices(column, BLOCK):
        if len(offsets) > 2 or len(data) <= 2 * BLOCK:
            yield at, 0, offsets, data
        else:
            for begin in range(0, len(data) - window + 1, BLOCK):
                part = data[begin : begin + BLOCK + window - 1]
                yield at, begin, np.array([0, len(part)]), part


def anchored(offsets: np.ndarray, data: np.ndarray, window: int):
    """(row, first start and number of the strings of each anchor, its place among all strings, starts of all strings, the anchors'
    identifiers); None where no string fits."""
    sizes = np.maximum(np.diff(offsets) - window + 1, 0)
    total = int(sizes.sum())
    if not total:
        return None
    heads = np.cumsum(sizes) - sizes
    starts = np.arange(total) + np.repeat(offsets[:-1] - heads, sizes)
    grams = identifiers(data, DEPTH, 1)
    place = anchors(grams, starts, window - DEPTH + 1)
    fresh = np.ones(total, bool)
    fresh[1:] = place[1:] != place[:-1]
    head = np.flatnonzero(fresh)
    row = np.searchsorted(offsets, place[head], "right") - 1
    return row, starts[head] - offsets[row], np.diff(np.append(head, total)), head, starts, place[head], grams[place[head]]


def listed(strings: np.ndarray, head: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One identifier for the strings of each anchor, in order."""
    place = np.arange(len(strings)) - np.repeat(head, sizes)
    return mix(np.add.reduceat(mix(strings + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), head))


def _signed(x: np.ndarray):
    import pyarrow as pa

    return pa.array(x.view(np.int64))


def _bucketer(window: int):
    """h of each anchor."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for _, _, offsets, data in blocks(batch.column(0), window):
                if (found := anchored(offsets, data, window)) is not None:
                    yield pa.RecordBatch.from_arrays([_signed(found[-1])], ["h"])

    return run


def _refiner(window: int):
    """Each anchor with its context: document, h, g, and where its strings are (first start and number, in one value)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at, begin, offsets, data in blocks(batch.column(1), window):
                if (found := anchored(offsets, data, window)) is None:
                    continue
                row, first, sizes, head, starts, _, grams = found
                whole_ = listed(identifiers(data, window, 2)[starts], head, sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + at)), _signed(grams), _signed(whole_), pa.array((first + begin) << RUN | sizes)], ["o", "h", "g", "run"])

    return run


def _lister(window: int):
    """The strings of wanted contexts (by their first start), SEGMENT of them at most in a row: document, h, g, first start, the identifier of
    the bytes that all strings of the segment have, and the identifiers of the strings. Segments are cut by their distance from the
    anchor, so equal strings lie at equal places of equal segments."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            wanted = [np.array(x, np.int64) for x in batch.column(2).to_pylist()]
            for at, begin, offsets, data in blocks(batch.column(1), window):
                if (found := anchored(offsets, data, window)) is None:
                    continue
                row, first, sizes, head, starts, place, grams = found
                edges = np.searchsorted(row, np.arange(len(offsets)))
                use = np.concatenate([a + np.flatnonzero(np.isin(first[a:b] + begin, wanted[at + r])) for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))])
                if not len(use):
                    continue
                strings = identifiers(data, window, 2)
                common = identifiers(data, window - SEGMENT + 1, 3)
                whole_ = listed(strings[starts], head, sizes)
                # All strings of the wanted contexts, one after the other, and where a segment begins.
                n = sizes[use]
                start = np.repeat(starts[head[use]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                context = np.repeat(use, n)
                segment = (place[context] - start) // SEGMENT
                fresh = np.ones(len(start), bool)
                fresh[1:] = (context[1:] != context[:-1]) | (segment[1:] != segment[:-1])
                cut = np.flatnonzero(fresh)
                of, number = context[cut], segment[cut]
                # The bytes from the last start of a whole segment on stand in each of its strings.
                shared = common[np.maximum(place[of] - number * SEGMENT, 0)] + mix(number.astype(np.uint64))
                lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(start)).astype(np.int32)), _signed(strings[start]))
                columns = [_signed(grams[of]), _signed(whole_[of]), pa.array(start[cut] - offsets[row[of]] + begin), _signed(shared), lists]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[of] + at)), *columns], ["o", "h", "g", "start", "c", "w"])

    return run


def covered(first: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of bytes that strings starting in [first, first + size) cover."""
    order = np.argsort(first, kind="stable")
    begin, end = first[order], np.maximum.accumulate((first + sizes + window - 1)[order])
    fresh = np.ones(len(begin), bool)
    fresh[1:] = begin[1:] > end[:-1]
    at = np.flatnonzero(fresh)
    return begin[at], end[np.append(at[1:], len(end)) - 1]


def _cutter(window: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            removed, spans, digests, kept = [], [], [], []
            marks = batch.column(2)
            edges, flat = marks.offsets.to_numpy(), marks.values.to_numpy()
            texts = batch.column(1).cast(pa.large_binary())
            for i in range(batch.num_rows):
                raw = texts[i].as_buffer()
                runs = flat[edges[i] : edges[i + 1]]
                begin, end = covered(runs >> RUN, runs & ((1 << RUN) - 1), window)
                text = memoryview(raw)
                left = b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), raw.size], strict=True))
                removed.append(raw.size - len(left))
                spans.append(len(begin))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())], ["o", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _numbered(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """docs as o (a long in the order of the documents), text and row (all columns). Ids that are distinct integers are their own numbers;
    else the distinct pairs of id and text are counted off, by ranges of the sorted pairs, and the texts are shuffled once to meet them."""
    ids = docs.select(F.col(id_col).alias("id"))
    if ids.schema["id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") and ids.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        return docs.select(F.col(id_col).cast("long").alias("o"), whole(F.col(text_col)).alias("text"), F.struct("*").alias("row"))
    key = F.sha2(whole(F.col(text_col)), 256)
    ordered = docs.select(F.col(id_col).alias("id"), key.alias("key")).distinct().orderBy(F.col("id").asc_nulls_last(), "key")
    ordered = scratch.write(ordered.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "ordered")
    first, seen, rows = {}, 0, ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place")).orderBy("part").collect()
    for r in rows:
        first[r.part], seen = seen - r.place, seen + r.n
    shift = F.create_map(*[F.lit(x).cast("long") for pair in first.items() for x in pair]) if first else None
    numbers = ordered.select("id", "key", (F.col("place") + shift[F.col("part").cast("long")] if first else F.col("place")).alias("o"))
    left = docs.select(F.col(id_col).alias("id"), key.alias("key"), whole(F.col(text_col)).alias("text"), F.struct("*").alias("row"))
    met = left.alias("a").join(numbers.alias("b"), (F.col("a.key") == F.col("b.key")) & F.col("a.id").eqNullSafe(F.col("b.id")))
    return scratch.write(met.select("b.o", "a.text", "a.row"), "numbered")


def _removed(slim: DataFrame, window: int, scratch: Scratch, texts: bool) -> DataFrame:
    """A row per document that loses bytes: o, n_removed, n_spans, kept_sha256, and with texts what is kept. slim: o, text."""
    if not DEPTH + SEGMENT <= window <= BLOCK:
        raise ValueError(f"a window has {DEPTH + SEGMENT} to {BLOCK} bytes")

    # 1. Buckets of equal 32-grams with two suffixes or more.
    buckets = slim.select("text").mapInArrow(_bucketer(window), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    buckets = scratch.write(buckets.where("n > 1").select("h"), "buckets")
    scratch.release()

    # 2. Their suffixes, refined by contexts; the first document of each.
    suffixes = scratch.write(slim.mapInArrow(_refiner(window), "o long, h long, g long, run long").join(buckets, "h"), "suffixes")
    scratch.drop("buckets")
    scratch.release()
    refined_ = scratch.write(suffixes.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("first")), "contexts")
    scratch.release()
    several = scratch.write(refined_.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h", F.lit(True).alias("mixed")), "several")
    shared = refined_.join(several, "h", "left").where("n > 1 or mixed").select("h", "g", "first", F.coalesce("mixed", F.lit(False)).alias("mixed"))
    met = scratch.write(suffixes.join(scratch.write(shared, "shared"), ["h", "g"]), "met")
    scratch.drop("suffixes", "contexts", "several", "shared")
    scratch.release()
    behind = met.where("o > first").select("o", "run")
    own = met.where("o = first").groupBy("h", "g", "o", "mixed").agg(F.min("run").alias("one"), F.count(F.lit(1)).alias("n"))
    own = scratch.write(own, "own")
    again = met.where("o = first").join(own.where("n > 1").select("h", "g", "one"), ["h", "g"]).where("run > one").select("o", "run")

    # 3. Buckets of several contexts, refined to single strings: by segments first, whose common bytes must repeat.
    wanted = scratch.write(own.where("mixed").groupBy("o").agg(F.collect_set(F.shiftright("one", RUN)).alias("firsts")), "wanted")
    segments = slim.join(wanted, "o").select("o", "text", "firsts").dropDuplicates(["o"]).mapInArrow(_lister(window), "o long, h long, g long, start long, c long, w array<long>")
    segments = scratch.write(segments, "segments")
    scratch.release()
    common = scratch.write(segments.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "c"), "common")
    strings = segments.join(common, ["h", "c"]).select("o", "h", "start", F.posexplode("w").alias("i", "w"))
    strings = scratch.write(strings.select("o", "h", "w", (F.col("start") + F.col("i")).alias("start")), "strings")
    scratch.drop("segments", "common", "wanted")
    place = F.struct("o", "start")
    early = scratch.write(strings.groupBy("h", "w").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one")).where("n > 1").select("h", "w", "one"), "early")
    later = strings.join(early, ["h", "w"]).where(place > F.col("one")).select("o", F.shiftleft("start", RUN).bitwiseOR(F.lit(1)).alias("run"))

    marks = behind.unionByName(again).unionByName(later).groupBy("o").agg(F.collect_list("run").alias("marks"))
    marks = scratch.write(marks, "marks")
    scratch.drop("met", "own", "strings", "early")
    scratch.release()
    cut = slim.join(marks, "o").select("o", "text", "marks").dropDuplicates(["o"]).mapInArrow(_cutter(window), "o long, n_removed long, n_spans long, kept_sha256 string, kept string")
    cut = scratch.write(cut if texts else cut.drop("kept"), "cut")
    scratch.drop("marks")
    scratch.release()
    return cut


def digest(docs: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    rows = _numbered(docs.select(id_col, text_col), id_col, text_col, scratch)
    cut = _removed(rows.select("o", "text"), window, scratch, False)
    slim = rows.select("o", F.col("row")[id_col].alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha"))
    none = F.lit(0).cast("long")
    return slim.join(cut, "o", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256")
    )


def remove(docs: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the texts that lost bytes replaced by what is left; other texts and columns as they were."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    rows = _numbered(docs, id_col, text_col, scratch)
    cut = _removed(rows.select("o", "text"), window, scratch, True).select("o", "kept")
    text = F.coalesce(F.col("kept"), F.col("row")[text_col])
    return rows.select("o", "row").join(cut, "o", "left").select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
