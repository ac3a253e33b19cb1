"""SentencePiece encoding and decoding by a batched numpy Viterbi: words of equal length advance together, hashes of their substrings
probe the sorted keys of the pieces, and vectorised maxima store the backpointers.

Unigram models maximise the sum of the piece scores. BPE models have no scores to add up; there a segmentation is the model's own
exactly if each two neighbours stay apart when the merges run over the two alone, so the recurrence gives a candidate that fails
this the value minus infinity and the maximum over what is left is unique. Pairs are judged for a whole column of words at once, by
undoing merges from the later one back.

Words: a text is cut wherever no piece of the model has the two signs side by side (before a space, between a letter and a full stop,
and so on); no segmentation has a piece across such a place, so the words between are encoded alone. Each distinct word is
segmented once for as long as a bounded memory holds it (`wordmemory`); the ids of a text are gathered from there by hash and
compared bytes, and decoding gathers the bytes of the pieces, both for a slice of about a megabyte at once.

Supported models: BPE or unigram, identity normaliser, spaces escaped, a leading space added, byte fallback. Rows: a null text counts as
empty and has no ids. The meta sign U+2581 in a text decodes to a space, as in the library. Repeated rows, null ids and extra
columns change nothing; empty tables give empty results. A very long text is a slice of its own. A word without any cut is
segmented whole, one sign after the other, however long: slow beyond some hundred thousand signs, never wrong."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import run_hashes, text_slices, whole
from caselens.llm.wordmemory import WordMemory, ragged

SPACE = "▁"
#: Signs beyond ASCII are one class.
CLASSES = 129
NONE = np.int64(1) << np.int64(40)
BASE = np.uint64(0x9E3779B97F4A7C15)


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hash of every prefix of every row."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * BASE + (codes[:, j].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
    return out


class PieceTable:
    """The pieces of a model, by hash for each length; for BPE also all merges and how each piece comes about."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.escape_whitespaces and norm.add_dummy_prefix and train.byte_fallback) or train.model_type not in (1, 2):
            raise ValueError("unsupported kind of SentencePiece model")
        self.bpe = train.model_type == 2
        self.pieces = [p.piece for p in model.pieces]
        normal = [i for i, p in enumerate(model.pieces) if p.type in (1, 4)]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece has a space behind another sign")
        self.bytes = np.zeros(256, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
        self.scores = np.array([p.score for p in model.pieces])
        self.unknown = len(self.pieces)  # stands for a sign that is no piece
        self.unknown_score = float(self.scores[normal].min()) - 10
        self.glued = np.zeros((CLASSES, CLASSES), bool)  # classes of signs that stand side by side in some piece
        self.glued[-1, -1] = True
        for i in normal:
            signs = [min(ord(c), CLASSES - 1) for c in self.pieces[i].replace(SPACE, " ")]
            self.glued[signs[:-1], signs[1:]] = True
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[int]] = {}
        for i in normal:
            by_length.setdefault(len(self.pieces[i]), []).append(i)
        for length, ids in by_length.items():
            keys = _prefix_hashes(_codes([self.pieces[i] for i in ids], length))[:, -1]
            order = np.argsort(keys)
            if len(np.unique(keys)) < len(keys):
                raise ValueError("two pieces have one hash")
            self.keys[length] = keys[order], np.array(ids, np.int64)[order]
        self.lengths = sorted(self.keys, reverse=True)
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(self.lengths, default=1) + 1, BASE, np.uint64)]), dtype=np.uint64)
        if self.bpe:
            self._merges({self.pieces[i]: i for i in normal})
        self.shown = [p.piece.replace(SPACE, " ").encode() if p.type in (1, 4) else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else " ⁇ ".encode() if p.type == 2 else b"" for p in model.pieces]

    def _merges(self, ids: dict[str, int]) -> None:
        """rank, left and right part of each piece, and the rank of each pair that can merge."""
        order = sorted((i for p, i in ids.items() if len(p) > 1), key=lambda i: (-self.scores[i], i))
        self.rank = np.full(self.unknown + 1, -1, np.int64)
        self.rank[order] = np.arange(len(order))
        self.left, self.right = np.full(self.unknown + 1, -1, np.int64), np.full(self.unknown + 1, -1, np.int64)
        self.whole = np.ones(self.unknown + 1, bool)
        pairs, ranks = [], []
        for i in order:
            p = self.pieces[i]
            for at in range(1, len(p)):
                a, b = ids.get(p[:at]), ids.get(p[at:])
                if a is not None and b is not None:
                    pairs.append(a * (self.unknown + 1) + b)
                    ranks.append(self.rank[i])
            parts, last = list(p), None
            while len(parts) > 1:
                best = min(((self.rank[ids[a + b]], j) for j, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ids), default=None)
                if best is None:
                    break
                last = parts[best[1]], parts[best[1] + 1]
                parts[best[1] : best[1] + 2] = [last[0] + last[1]]
            if len(parts) == 1 and last[0] in ids and last[1] in ids:
                self.left[i], self.right[i] = ids[last[0]], ids[last[1]]
            else:
                self.whole[i] = False  # merges never end in this piece
        by = np.argsort(np.array(pairs, np.int64))
        self.pair_keys, self.pair_ranks = np.array(pairs, np.int64)[by], np.array(ranks, np.int64)[by]

    def find(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """The piece of each substring hash of this length, -1 where there is none."""
        keys, ids = self.keys[length]
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, ids[at], -1)

    def apart(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbours survives when the merges run over the text of both."""
        out, open_ = np.ones(len(one), bool), np.arange(len(one))
        one, two, limit = one.copy(), two.copy(), np.full(len(one), NONE)
        while len(open_):
            key = one * (self.unknown + 1) + two
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            joined = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)
            r1, r2 = self.rank[one], self.rank[two]
            fails = joined < limit
            out[open_[fails]] = False
            go = ~fails & ((r1 >= 0) | (r2 >= 0))
            open_, one, two, r1, r2 = open_[go], one[go], two[go], r1[go], r2[go]
            # The later of the two is undone; of equal ones the right one came later.
            first = r1 > r2
            limit = np.where(first, r1, r2 + 1)
            one, two = np.where(first, self.right[one], one), np.where(first, two, self.left[two])
        return out

    def segment(self, words: list[str]) -> list[list[int]]:
        """Piece ids of words of one length; self.unknown for a sign that is no piece."""
        length = len(words[0])
        hashes = _prefix_hashes(_codes(words, length))
        n = len(words)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        last, back = np.full((n, length + 1), -1, np.int64), np.zeros((n, length + 1), np.int64)
        for end in range(1, length + 1):
            open_ = np.arange(n)
            for size in self.lengths:
                if size > end or not len(open_):
                    continue
                start = end - size
                found = self.find(hashes[open_, end] - hashes[open_, start] * self.powers[size], size)
                if size == 1:
                    found = np.where(found < 0, self.unknown, found)
                has = found >= 0
                rows, ids = open_[has], found[has]
                if self.bpe:
                    fits = self.whole[ids] if start == 0 else (last[rows, start] >= 0) & self.whole[ids]
                    if start:
                        fits[fits] = self.apart(last[rows[fits], start], ids[fits])
                    value = np.where(fits, 0.0, -np.inf)
                else:
                    value = best[rows, start] + np.where(ids == self.unknown, self.unknown_score, self.scores[np.minimum(ids, self.unknown - 1)])
                better = value > best[rows, end]
                rows, ids = rows[better], ids[better]
                best[rows, end], last[rows, end], back[rows, end] = value[better], ids, start
                if self.bpe:  # the piece that fits is the only one
                    open_ = open_[last[open_, end] < 0]
        out = []
        ends, lasts, backs = [length] * n, last.tolist(), back.tolist()
        for i in range(n):
            ids, end = [], ends[i]
            while end:
                ids.append(lasts[i][end])
                end = backs[i][end]
            out.append(ids[::-1])
        return out


class Encoder:
    """Encodes and decodes columns of texts, with a memory of words that `memory` bounds."""

    def __init__(self, path: str, **memory):
        self.table = PieceTable(path)
        self.memory = WordMemory(self._learned, "<u4", **memory)
        self.glued = self.table.glued.ravel()
        self.shown = np.frombuffer(b"".join(self.table.shown), np.uint8)
        self.shown_length = np.array([len(x) for x in self.table.shown], np.int64)
        self.shown_start = np.cumsum(self.shown_length) - self.shown_length

    def _learned(self, words: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        groups: dict[int, list[tuple[int, str]]] = {}
        for i, w in enumerate(words):
            text = w.decode().replace(" ", SPACE)
            groups.setdefault(len(text), []).append((i, text))
        for length, group in sorted(groups.items()):
            step = max(1, (1 << 22) // (length + 1))
            for at in range(0, len(group), step):
                part = group[at : at + step]
                for (i, text), ids in zip(part, self.table.segment([t for _, t in part]), strict=True):
                    out[i] = np.array(self._with_bytes(text, ids) if self.table.unknown in ids else ids, np.uint32)
        return out

    def _with_bytes(self, text: str, ids: list[int]) -> list[int]:
        """Ids with the bytes of a sign in place of each unknown one."""
        out, place = [], 0
        for i in ids:
            if i == self.table.unknown:
                out += self.table.bytes[list(text[place].encode())].tolist()
                place += 1
            else:
                out.append(i)
                place += len(self.table.pieces[i])
        return out

    def encode_column(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, first id of each row plus the total)."""
        meta, raw = SPACE.encode(), data.tobytes()
        if meta in raw:
            rows = [raw[a:b].replace(meta, b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            offsets, data = np.cumsum([0] + [len(r) for r in rows]), np.frombuffer(b"".join(rows), np.uint8)
        offsets, data = spaced(offsets, data)
        signs = np.minimum(data, np.uint8(CLASSES - 1)).astype(np.uint16)
        edge = np.ones(len(data), bool)
        edge[1:] = ~self.glued[signs[:-1] * np.uint16(CLASSES) + signs[1:]]
        edge[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        ids, n = self.memory.encode(run_hashes(data, starts, ends - starts), starts, ends, data)
        return ids, np.append(0, np.cumsum(n))[np.searchsorted(starts, offsets)]

    def decode_column(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all rows with the space that the model puts before each, first byte of each row plus the total)."""
        n = self.shown_length[ids]
        return self.shown[ragged(self.shown_start[ids], n)], np.append(0, np.cumsum(n))[first]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        ids, first = self.encode_column(np.cumsum([0] + [len(t) for t in texts]), np.frombuffer(b"".join(texts), np.uint8))
        return [ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]

    def decode(self, ids: bytes) -> str:
        found = np.frombuffer(ids, "<u4")
        return shown_text(self.decode_column(found, np.array([0, len(found)]))[0].tobytes())


def spaced(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a space before each that is not empty."""
    has = np.diff(offsets) > 0
    moved = offsets + np.append(0, np.cumsum(has))
    out = np.full(moved[-1], 0x20, np.uint8)
    own = np.ones(len(out), bool)
    own[moved[:-1][has]] = False
    out[own] = data
    return moved, out


def shown_text(raw: bytes) -> str:
    text = raw.decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _frame(columns: list, names: list[str]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(columns, names)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, ids (array<int>), decoded (the text that the ids give back)."""
    slim = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("text"))

    def run(batches):
        import pyarrow as pa

        encoder = encoder_of(model)
        for batch in batches:
            for at, offsets, data in text_slices(batch.column(1)):
                ids, first = encoder.encode_column(offsets, data)
                shown, places = encoder.decode_column(ids, first)
                decoded = [shown_text(shown[a:b].tobytes()) for a, b in zip(places[:-1], places[1:], strict=True)]
                yield _frame([batch.column(0).slice(at, len(decoded)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.view(np.int32))), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def _round_trips(encoder: Encoder, ids: np.ndarray, first: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Whether the ids of each row give its text back."""
    shown, places = encoder.decode_column(ids, first)
    at, text = spaced(offsets, data)
    if len(shown) == len(text) and (places == at).all() and (shown == text).all():
        return np.ones(len(offsets) - 1, bool)
    rows = zip(places[:-1], places[1:], offsets[:-1], offsets[1:], strict=True)
    return np.array([shown_text(shown[a:b].tobytes()).encode() == data[c:d].tobytes() for a, b, c, d in rows])


def encode_digest(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_ids, ids_crc32 (of the ids as little-endian 32-bit numbers), round_trip (decoding gives the text)."""
    slim = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("text"))

    def run(batches):
        import pyarrow as pa

        encoder = encoder_of(model)
        for batch in batches:
            for at, offsets, data in text_slices(batch.column(1)):
                ids, first = encoder.encode_column(offsets, data)
                same, raw = _round_trips(encoder, ids, first, offsets, data), memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield _frame([batch.column(0).slice(at, len(sums)), pa.array(np.diff(first)), pa.array(sums, pa.int64()), pa.array(same)], ["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_ids long, ids_crc32 long, round_trip boolean")
