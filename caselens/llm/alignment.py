"""Cross-tokenizer alignment: a label for each byte of a text says whether a token of A, of B, of both or of none ends there; a regular
expression scans the label string for spans up to each both-label, and the labels inside a span say which tokens form a group.

A is a byte-level BPE, B a SentencePiece BPE with byte fallback that puts a space before each text; A reads the text with that space.
Tokens of A and B are linked where their byte ranges overlap. The count of a pair of ids is the number of documents that hold it linked.

Chunks: no token of A or B reaches from a sign that is not white space into the space behind it, so a text is cut there, both
tokenizers end a token there, and groups and links are those of its chunks. Labels, spans and links are made once for each chunk that is new
to a task, as one label string for all new chunks of a slice; a bounded memory (`wordmemory`) looks chunks up by hash and compared bytes.

1. Each task counts, for each pair, its documents (distinct pairs of a document, numpy); the counts of all tasks are summed by Spark.
2. The counts meet the chunks again. Up to `most_pairs` distinct pairs are broadcast as sorted arrays; beyond that each document's
   pairs are joined with the written counts, whose hot pairs adaptive execution can split.

Rows: null and empty texts, and texts whose tokens do not spell space + text (the sign U+2581 is a space for B), have no tokens, no
links and an empty groups_sha256, and count for no pair. Repeated rows are documents of their own, each counted; null ids stay. A very long
text is one slice, read whole; a text without a space behind a sign is one chunk, encoded whole. Empty tables give empty results; extra
columns are not read."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import Scratch, run_hashes, text_slices, whole
from caselens.llm.sentpiece import SPACE, spaced
from caselens.llm.wordmemory import Pool, WordMemory, ragged

A_END, B_END, BOTH = 1, 2, 3
SPAN = re.compile(rb"[\x00-\x02]*\x03")
PAIR = np.int64(1) << np.int64(32)


def byte_level(token: str, byte_of: dict[str, int]) -> bytes:
    return bytes(byte_of[c] for c in token)


def byte_signs() -> dict[str, int]:
    """The byte of each sign of a byte-level vocabulary: visible Latin-1 signs stand for themselves, the others are numbered from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Bytes of each token id, as one array with starts and lengths."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.starts[ids], self.lengths[ids])]


@lru_cache(maxsize=4)
def load_a(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    byte_of, tokens = byte_signs(), [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        tokens[i] = byte_level(token, byte_of) if set(token) <= byte_of.keys() else token.encode()
    return tokenizer, Vocabulary(tokens)


@lru_cache(maxsize=4)
def load_b(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        tokens.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(SPACE, " ").encode())
    return model, Vocabulary(tokens)


def label_string(a_ends: np.ndarray, b_ends: np.ndarray, n: int) -> np.ndarray:
    """One label for each of n bytes."""
    labels = np.zeros(n, np.uint8)
    labels[a_ends - 1] = A_END
    labels[b_ends - 1] |= B_END
    return labels


def group_ends(labels: np.ndarray) -> np.ndarray:
    """End byte of each span up to a both-label."""
    return np.cumsum(np.fromiter(map(len, SPAN.findall(labels.tobytes())), np.int64))


#: White space beyond ASCII, as its last bytes; no cut behind one.
_WIDE_SPACES = ["\u0085", "\u00a0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
_WIDE = {s.encode()[-2:] for s in _WIDE_SPACES}


def chunk_starts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """First byte of each chunk of rows that begin with a space: each space behind a sign that is no white space."""
    space = data == 0x20
    before = np.zeros(len(data), np.uint8)
    before[1:] = data[:-1]
    cut = space & (before > 0x20) & (before < 0x7F)
    wide = np.flatnonzero(space & (before >= 0x80))
    if len(wide):
        last = (data[wide - 2].astype(np.uint16) << np.uint16(8)) | data[wide - 1]
        cut[wide] = ~np.isin(last, [int.from_bytes(w, "big") for w in _WIDE])
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


class Chunks(WordMemory):
    """What is known of each chunk: sizes, links, the text of its groups, and with given counts what its links add up to."""

    def __init__(self, a_path: str, b_path: str, counts=None, keep_text: bool = True, slots: int = 1 << 21, most_bytes: int = 24 << 20):
        self.a, self.a_vocab = load_a(a_path)
        self.b, self.b_vocab = load_b(b_path)
        self.counts, self.keep_text = counts, keep_text
        shown = lambda n, tail: [f"{i}{tail}" for i in range(n)]
        na, nb = len(self.a_vocab.lengths), len(self.b_vocab.lengths)
        # Each id with the sign behind it: inside a group's side or at its end.
        self.shown = np.array([*shown(na, ","), *shown(na, "|"), *shown(nb, ","), *shown(nb, ";")], object)
        self.before_b = 2 * na
        self.number, self.pairs = {}, Pool(np.int64)
        super().__init__(self._learned, np.int64, slots=slots, most_bytes=most_bytes)

    def clear(self) -> None:
        super().clear()
        #: Of each chunk: tokens of A, of B, groups, links, best links, whether its bytes are not spelled; sum of counts apart.
        self.facts, self.sums = Pool(np.int32), Pool(np.int64)
        self.links, self.link_start = Pool(np.int32), Pool(np.int64)
        self.texts: list[str] = []

    WIDTH = 6

    def _learned(self, words: list[bytes]) -> list[np.ndarray]:
        first = self.facts.size // self.WIDTH
        texts = [w.decode() for w in words]
        a_ids = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # B puts the first space there itself, but nothing before an empty text.
        b_ids = [ids or [self.b.piece_to_id(SPACE)] for ids in self.b.encode([t[1:] for t in texts], num_threads=1)]
        size = np.fromiter(map(len, words), np.int64, len(words))
        good = np.ones(len(words), bool)
        sides = []
        for lists, vocab in ((a_ids, self.a_vocab), (b_ids, self.b_vocab)):
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.fromiter(chain.from_iterable(lists), np.int64, n.sum())
            got = np.append(0, np.cumsum(vocab.lengths[ids]))[np.append(0, np.cumsum(n))]
            good &= np.diff(got) == size
            sides.append((n, ids, vocab))
        raw = np.frombuffer(b"".join(words), np.uint8)
        edges = np.append(0, np.cumsum(size))
        for n, ids, vocab in sides:
            use = np.repeat(good, n)
            same = vocab.spelled(ids[use]) == raw[np.repeat(good, size)]
            if not same.all():
                rows = np.flatnonzero(good)[np.searchsorted(np.cumsum(size[good]), np.flatnonzero(~same), "right")]
                good[rows] = False
        facts, sums = np.zeros((len(words), self.WIDTH), np.int32), np.zeros(len(words), np.int64)
        facts[:, 5] = ~good
        (na, a, _), (nb, b, _) = sides
        na, a, nb, b = np.where(good, na, 0), a[np.repeat(good, na)], np.where(good, nb, 0), b[np.repeat(good, nb)]
        n_bytes = np.where(good, size, 0)
        ends = np.cumsum(n_bytes)
        a_ends, b_ends = np.cumsum(self.a_vocab.lengths[a]), np.cumsum(self.b_vocab.lengths[b])
        labels = label_string(a_ends, b_ends, int(n_bytes.sum()))
        spans = group_ends(labels)
        marks = np.flatnonzero(labels)  # each end of a token closes one overlap
        a_of, b_of = np.searchsorted(a_ends, marks + 1), np.searchsorted(b_ends, marks + 1)
        links = a[a_of] * PAIR + b[b_of]
        each = lambda places: np.diff(np.append(0, np.searchsorted(places, ends, "right")))
        facts[:, 0], facts[:, 1], facts[:, 2], n_links = na, nb, each(spans), each(marks + 1)
        facts[:, 3] = n_links
        if self.counts is not None and len(links):
            keys, count, best = self.counts
            at = np.searchsorted(keys, links)
            rows = np.repeat(np.arange(len(words)), n_links)
            facts[:, 4] = np.bincount(rows, best[at], len(words))
            np.add.at(sums, rows, count[at])
        elif self.counts is None:
            self.link_start.add(self.links.size + np.cumsum(n_links) - n_links)
            self.links.add(self._numbers(links))
        self.facts.add(facts.ravel())
        self.sums.add(sums)
        if self.keep_text:
            self.texts += self._group_texts(a, a_ends, b, b_ends, spans, ends)
        return list((first + np.arange(len(words), dtype=np.int64))[:, None])

    def _group_texts(self, a, a_ends, b, b_ends, spans, ends) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each chunk."""
        a_group, b_group = np.searchsorted(spans, a_ends), np.searchsorted(spans, b_ends)
        out = np.empty(len(a) + len(b), object)
        # In the text of all groups A's tokens of a group stand before B's.
        a_place = np.arange(len(a)) + np.searchsorted(b_group, a_group)
        b_place = np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")
        na = len(self.a_vocab.lengths)
        out[a_place] = self.shown[a + na * np.isin(a_ends, spans)]
        out[b_place] = self.shown[self.before_b + b + len(self.b_vocab.lengths) * np.isin(b_ends, spans)]
        last = np.searchsorted(a_ends, ends, "right") + np.searchsorted(b_ends, ends, "right")
        tokens, texts, at = out.tolist(), [], 0
        for to in last.tolist():
            texts.append("".join(tokens[at:to])[:-1])
            at = to
        return texts

    def _numbers(self, links: np.ndarray) -> np.ndarray:
        """A small number of the task's own for each pair."""
        each, back = np.unique(links, return_inverse=True)
        known = self.number
        small = np.array([known.setdefault(p, len(known)) for p in each.tolist()], np.int64)
        self.pairs.add(each[small >= self.pairs.size])  # numbered in this order
        return small[back]

    def forget(self) -> None:
        """Starts anew, the numbers of pairs included."""
        self.clear()
        self.number, self.pairs = {}, Pool(np.int64)

    def column(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chunk of each chunk of all rows, first chunk of each row plus the total)."""
        offsets, data = spaced(offsets, data)
        starts = chunk_starts(offsets, data)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        found, _ = self.encode(run_hashes(data, starts, ends - starts), starts, ends, data)
        return found, np.searchsorted(starts, offsets)

    def fact(self, chunks: np.ndarray) -> np.ndarray:
        return self.facts.data[: self.facts.size].reshape(-1, self.WIDTH)[chunks]

    def links_of(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.fact(chunks)[:, 3]
        return self.links.data[ragged(self.link_start.data[chunks], n)], n


_memory: dict = {}


def chunks_of(a_path: str, b_path: str, counts=None, keep_text: bool = True, label: str = "") -> Chunks:
    """The memory of this worker process: chunks that one task has learned serve the next. `label` tells the counts of one call from those
    of others; the memory holds one kind at a time."""
    key = a_path, b_path, keep_text, label
    if key not in _memory:
        _memory.clear()
        _memory[key] = Chunks(a_path, b_path, counts.value if counts is not None else None, keep_text)
    return _memory[key]


def _row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.append(np.zeros((1, values.shape[1]), np.int64), np.cumsum(values, axis=0, dtype=np.int64), axis=0)[first], axis=0)


def _good_rows(chunks: Chunks, found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows with tokens whose bytes are space + text."""
    return (np.diff(first) > 0) & (_row_sums(chunks.fact(found)[:, 5:], first)[:, 0] == 0)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorting beats numpy's hash table here."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def _pair_counter(a_path: str, b_path: str, most: int = 1 << 21):
    def run(batches):
        import pyarrow as pa

        chunks = chunks_of(a_path, b_path, keep_text=False)
        counts = np.zeros(1 << 16, np.int64)

        def told():
            seen = np.flatnonzero(counts[: chunks.pairs.size])
            return pa.RecordBatch.from_arrays([pa.array(chunks.pairs.data[seen]), pa.array(counts[seen])], ["pair", "n"])

        for batch in batches:
            for _, offsets, data in text_slices(batch.column(0)):
                found, first = chunks.column(offsets, data)
                good = _good_rows(chunks, found, first)
                rows = np.repeat(np.arange(len(good)), np.diff(first))
                use = good[rows]
                # Distinct chunks of each row, then distinct pairs.
                keys = distinct(rows[use] << 32 | found[use])
                links, n = chunks.links_of(keys & 0xFFFFFFFF)
                pairs = distinct(np.repeat(keys >> 32, n) << 32 | links) & 0xFFFFFFFF
                seen = np.bincount(pairs)
                if len(seen) > len(counts):
                    counts = np.append(counts, np.zeros(2 * len(seen) - len(counts), np.int64))
                counts[: len(seen)] += seen
                if len(chunks.number) > most:
                    yield told()
                    chunks.forget()
                    counts[:] = 0
        yield told()

    return run


DIGEST = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _digester(a_path: str, b_path: str, counts, label: str = "", most: int = 1 << 21):
    """counts: a broadcast value of (sorted pairs, counts, whether best), which `label` names, or None where the links are joined later."""

    def run(batches):
        import pyarrow as pa

        chunks = chunks_of(a_path, b_path, counts, label=label)
        for batch in batches:
            for at, offsets, data in text_slices(batch.column(1)):
                found, first = chunks.column(offsets, data)
                good = _good_rows(chunks, found, first)
                facts = np.append(chunks.fact(found)[:, :5].astype(np.int64), chunks.sums.data[found][:, None], axis=1)
                sums = np.where(good[:, None], _row_sums(facts, first), 0)
                texts, order = chunks.texts, found.tolist()
                edges = first.tolist()
                digests = [hashlib.sha256(";".join([texts[c] for c in order[a:b]]).encode()).hexdigest() if ok else "" for a, b, ok in zip(edges[:-1], edges[1:], good.tolist(), strict=True)]
                columns = [batch.column(0).slice(at, len(good)), *[pa.array(np.ascontiguousarray(sums[:, i])) for i in range(6)], pa.array(digests, pa.string())]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
                if counts is None:
                    rows = np.repeat(np.arange(len(good)), np.diff(first))
                    links, n = chunks.links_of(found[good[rows]])
                    keys, times = np.unique(np.stack([np.repeat(rows[good[rows]], n), links]), axis=1, return_counts=True)
                    ends = pa.array(np.searchsorted(keys[0], np.arange(len(good) + 1)).astype(np.int32))
                    columns += [pa.ListArray.from_arrays(ends, pa.array(chunks.pairs.data[keys[1]])), pa.ListArray.from_arrays(ends, pa.array(times))]
                    names += ["pairs", "times"]
                    if len(chunks.number) > most:
                        chunks.forget()
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pair_counts(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """pair (id of A * 2**32 + id of B), n (documents that hold it linked), best (no pair of its A id has more)."""
    parts = docs.select(whole(F.col(text_col)).alias("text")).mapInArrow(_pair_counter(a_path, b_path), "pair long, n long")
    scratch = Scratch(docs.sparkSession, "pairs")
    counted = scratch.write(parts.groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    most = scratch.write(counted.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most")), "most")
    return counted.join(most, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_digest(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = 4_000_000) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "alignment")
    counts = scratch.write(pair_counts(docs, a_path, b_path, text_col), "counts")
    slim = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("text"))
    kind = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {DIGEST}"
    if counts.count() <= most_pairs:
        table = counts.toArrow().sort_by("pair")
        arrays = table["pair"].to_numpy(), table["n"].to_numpy(), table["best"].to_numpy(zero_copy_only=False).astype(np.int64)
        return slim.mapInArrow(_digester(a_path, b_path, spark.sparkContext.broadcast(arrays), scratch.root), kind)
    found = scratch.write(slim.mapInArrow(_digester(a_path, b_path, None), f"{kind}, pairs array<long>, times array<long>").withColumn("row", F.monotonically_increasing_id()), "found")
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times")
    met = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("n")).alias("total"))
    met = scratch.write(met, "met")
    out = found.drop("pairs", "times", "n_best", "count_sum").join(met, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("best", F.lit(0).cast("long")).alias("n_best"), F.coalesce("total", F.lit(0).cast("long")).alias("count_sum"), "groups_sha256")


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The groups themselves: doc_id, group (its number), start and end byte in space + text, a_ids, b_ids; no rows for texts without tokens."""
    slim = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("text"))

    def run(batches):
        import pyarrow as pa

        (a, a_vocab), (b, b_vocab) = load_a(a_path), load_b(b_path)
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                raw = (" " + text).encode()
                ids = [np.array(x, np.int64) for x in (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text))]
                if not text or any(v.spelled(x).tobytes() != raw for v, x in zip((a_vocab, b_vocab), ids, strict=True)):
                    continue
                ends = [np.cumsum(v.lengths[x]) for v, x in zip((a_vocab, b_vocab), ids, strict=True)]
                spans = group_ends(label_string(*ends, len(raw)))
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.searchsorted(e, spans, "right")).astype(np.int32)), pa.array(x)) for e, x in zip(ends, ids, strict=True)]
                numbers = [pa.array(np.arange(len(spans))), pa.array(np.append(0, spans[:-1])), pa.array(spans)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(spans), i))), *numbers, *lists], ["doc_id", "group", "start", "end", "a_ids", "b_ids"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, group long, start long, end long, a_ids array<long>, b_ids array<long>")
