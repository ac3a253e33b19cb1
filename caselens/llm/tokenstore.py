"""Token-ID / binary output: a minimal perfect hash maps document keys to offsets in a shard of raw ids, with a stored fingerprint
of each key, so that a keyed read costs a few hash probes and one range read.

A store is a folder of shards in ascending key order. `ids-N.bin` holds the ids of its documents one after the other, nothing
else: little-endian, 2 bytes an id where the vocabulary allows it, else 4. `ids-N.idx` holds, after a header of ten 64-bit
numbers, the bit arrays of the perfect hash with a rank for each 64-bit word, and then by slot the fingerprint, the ordinal and by
ordinal the key, the null flag and the first id of each document.

`manifest.json` is written last: for each shard its name, its counts, the ids before it, and its first and last key. A folder without
one is no finished store. `Store` opens a folder by it and finds the shard of a key by bisection; a key whose rows lie in several shards
is numbered through all of them.

The hash is a cascade of bit arrays: a key whose position nobody else takes on a level is set there, the others go on to the next
level; a key's slot is the number of set bits before its own.

Rows: null texts count as empty and get the end id only. Null keys come first. Rows that repeat a key are kept side by side, in
order of the hash of their text, and numbered: `get(key, n)` reads the n-th; texts whose hashes tie are equal. Keys are integers. A
very long text is encoded whole, in a slice of its own. An empty table writes a manifest and no shard. Extra columns are not read. Writers put their files in place by a rename, so a task that runs twice leaves one whole shard."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from bisect import bisect_left
from collections import OrderedDict
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import LOWER, Scratch, mix, partitions_for, run_hashes, text_slices, whole, word_edges
from caselens.llm.wordmemory import WordMemory, ragged

MAGIC = 0x31304B54534C43
NULL_KEY = np.uint64(0x9D39247E33776D41)
PUNCT = rb"""!"#$%&()*+,-./:;=?@[\]^_`{}~"""


# ------------------------------------------------------------------------------------------------------ the hash


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.ranks = np.zeros(len(bits) + 1, np.int64)
        np.cumsum(np.bitwise_count(bits), out=self.ranks[1:])

    @staticmethod
    def position(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        sizes, words, level = [], [], 0
        while len(keys):
            if level > 200:
                raise ValueError("keys are not distinct")
            size = (max(64, int(gamma * len(keys))) + 63) // 64 * 64
            at = cls.position(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            keys = keys[~alone[at]]
            level += 1
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1, or some slot that the fingerprint then refutes, for strangers."""
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = self.position(keys[open_], level, int(size)) + base
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            own = self.bits[word]
            hit = (own >> bit) & np.uint64(1) == 1
            below = own[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = self.ranks[word[hit]] + np.bitwise_count(below)
            open_, base = open_[~hit], base + int(size)
        return out


def key_hashes(keys: np.ndarray, nulls: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    own = np.where(nulls, NULL_KEY, mix(keys.astype(np.int64).view(np.uint64)))
    return np.where(repeats == 0, own, mix(own + repeats.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)).astype(np.uint32)


def repeats_of(keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """Number of each row among those of its key; rows of a key stand side by side."""
    if not len(keys):
        return np.zeros(0, np.int64)
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))
    return np.arange(len(keys)) - start


# ---------------------------------------------------------------------------------------------------- the encoder


#: Classes of bytes: letters, plain punctuation, anything else inside a word.
LETTER, POINT, OTHER = 0, 1, 2
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[list(PUNCT)] = POINT
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER


def byte_classes(data: np.ndarray) -> np.ndarray:
    """LETTER for ASCII letters and both bytes of the letters U+00C0 to U+00FF."""
    out = _CLASS[data]
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    out[lead] = out[lead + 1] = LETTER
    return out


class WordEncoder:
    """Encodes with a tokenizer that drops white space, word by word with a bounded memory of words.

    Words of letters with a tail of plain punctuation are two pieces, as the tokenizer itself splits them; their ASCII letters
    are lower-cased, as it does. Everything else is kept whole."""

    def __init__(self, path: str, most: int = 1 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.memory = WordMemory(self._learned, f"<u{self.width}", slots=1 << (2 * most - 1).bit_length())

    def _learned(self, words: list[bytes]) -> list[np.ndarray]:
        coded = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, self.memory.dtype) for e in coded]

    def _pieces(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start and end byte of each piece, the bytes that stand for the pieces)."""
        starts, ends = word_edges(offsets, data)
        if not len(starts):
            return starts, ends, data
        kinds = byte_classes(data)
        lengths = ends - starts
        used, heads = ragged(starts, lengths), np.cumsum(lengths) - lengths
        own = kinds[used]
        letters = np.add.reduceat((own == LETTER).astype(np.int64), heads)
        # Letters first, then points only: as many bytes before the first point as there are letters.
        leading = np.minimum.reduceat(np.where(own == LETTER, lengths.max(), np.arange(len(used)) - np.repeat(heads, lengths)), heads)
        plain = (np.maximum.reduceat(own, heads) < OTHER) & (letters > 0) & (np.minimum(leading, lengths) == letters)
        bytes_ = data.copy()
        low = used[np.repeat(plain, lengths)]
        bytes_[low] = LOWER[data[low]]
        cuts = (starts + letters)[plain & (letters < lengths)]
        return np.sort(np.append(starts, cuts)), np.sort(np.append(ends, cuts)), bytes_

    def encode_column(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, first id of each row plus the total)."""
        starts, ends, data = self._pieces(offsets, data)
        ids, n = self.memory.encode(run_hashes(data, starts, ends - starts), starts, ends, data)
        return ids, np.append(0, np.cumsum(n))[np.searchsorted(starts, offsets)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        ids, first = self.encode_column(np.cumsum([0] + [len(t) for t in texts]), np.frombuffer(b"".join(texts), np.uint8))
        return [ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]


def ended(ids: np.ndarray, first: np.ndarray, end_id: int) -> np.ndarray:
    """The ids of all rows with the end id behind each row's own."""
    out = np.full(len(ids) + len(first) - 1, end_id, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = ids
    return out


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """One encoder for each worker process, so that its memory of words outlives a task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# ------------------------------------------------------------------------------------------------- writing and reading


#: Names that Hadoop has for stores which pyarrow knows by another one.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gcs", "viewfs": "hdfs"}


def _file_system(uri: str):
    from pyarrow import fs

    scheme, colon, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{colon}{rest}")


#: What a writer tells of its shard.
META = {"shard": "int64", "n_docs": "int64", "n_ids": "int64", "name": "string", "first_key": "int64", "last_key": "int64", "n_last": "int64"}


def _put(uri: str, attempt: str, write) -> None:
    system, path = _file_system(uri)
    with system.open_output_stream(f"{path}.{attempt}") as out:
        result = write(out)
    system.move(f"{path}.{attempt}", path)
    return result


def _writer(folder: str, tokenizer: str, end_id: int):
    def run(batches):
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), f"attempt{context.taskAttemptId()}"
        encoder = encoder_of(tokenizer)
        lengths, keys, nulls = [], [], []
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        first = next(batches, None)

        def payload(out):
            batch = first
            while batch is not None:
                ids = batch.column(0)
                nulls.append(ids.is_null().to_numpy(zero_copy_only=False))
                keys.append(ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False))
                for _, offsets, data in text_slices(batch.column(1)):
                    coded, starts = encoder.encode_column(offsets, data)
                    lengths.append(np.diff(starts) + 1)
                    out.write(ended(coded, starts, end_id).tobytes())
                batch = next(batches, None)

        if first is None or not first.num_rows:
            first = next((b for b in batches if b.num_rows), None) if first is not None else None
            if first is None:
                return
        name = f"{folder}/ids-{part:05d}"
        _put(f"{name}.bin", attempt, payload)
        key, null, n = np.concatenate(keys), np.concatenate(nulls), np.concatenate(lengths)
        hashes = key_hashes(key, null, repeats_of(key, null))
        table = PerfectHash.build(hashes)
        slot = table.slots(hashes)
        prints, order = np.zeros(len(key), np.uint32), np.zeros(len(key), np.uint32)
        prints[slot], order[slot] = fingerprints(hashes), np.arange(len(key), dtype=np.uint32)
        head = struct.pack("<10q", MAGIC, encoder.width, len(key), int(n.sum()), len(table.sizes), len(table.bits), end_id, part, 0, 0)
        starts = np.concatenate([[0], np.cumsum(n)]).astype("<i8")
        blocks = [head, table.sizes.astype("<i8"), table.bits.astype("<u8"), starts, key.astype("<i8"), prints.astype("<u4"), order.astype("<u4"), null.astype(np.uint8)]
        _put(f"{name}.idx", attempt, lambda out: [out.write(b if isinstance(b, bytes) else b.tobytes()) for b in blocks] and None)
        ends = [None if null[i] else int(key[i]) for i in (0, -1)]
        last = int(((key == key[-1]) & (null == null[-1])).sum())
        row = [part, len(key), int(n.sum()), name, *ends, last]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, META.values(), strict=True)], list(META))

    return run


class Shard:
    """A shard opened for reading."""

    def __init__(self, name: str):
        system, path = _file_system(f"{name}.idx")
        raw = system.open_input_stream(path).read()
        magic, self.width, self.n_docs, self.n_ids, levels, words, self.end_id, *_ = struct.unpack_from("<10q", raw)
        if magic != MAGIC:
            raise ValueError(f"{name}.idx is no index of token ids")
        at = 80

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype, n, at)
            at += out.nbytes
            return out

        self.hash = PerfectHash(take("<i8", levels), take("<u8", words))
        self.starts, self.keys = take("<i8", self.n_docs + 1), take("<i8", self.n_docs)
        self.prints, self.order, self.nulls = take("<u4", self.n_docs), take("<u4", self.n_docs), take("u1", self.n_docs).astype(bool)
        system, path = _file_system(f"{name}.bin")
        self.file = system.open_input_file(path)

    def ordinals(self, keys: np.ndarray, nulls: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """The ordinal of each key, -1 for keys that aren't here."""
        hashes = key_hashes(keys, nulls, repeats)
        slot = self.hash.slots(hashes)
        here = slot >= 0
        here[here] = self.prints[slot[here]] == fingerprints(hashes[here])
        return np.where(here, self.order[np.where(here, slot, 0)].astype(np.int64) if self.n_docs else -1, -1)

    def range(self, first: int, last: int) -> np.ndarray:
        """The ids from place `first` up to `last` of the shard, in one read."""
        self.file.seek(first * self.width)
        return np.frombuffer(self.file.read((last - first) * self.width), f"<u{self.width}").astype("<u4")

    def ids(self, ordinal: int) -> np.ndarray:
        return self.range(int(self.starts[ordinal]), int(self.starts[ordinal + 1]))

    def checksums(self, ordinals: np.ndarray, most: int = 1 << 22) -> np.ndarray:
        """crc32 of the ids of each ordinal; neighbours are read together, `most` ids at a time or one document."""
        out, at, starts = np.zeros(len(ordinals), np.int64), 0, self.starts
        while at < len(ordinals):
            to = at + 1
            while to < len(ordinals) and ordinals[to] == ordinals[to - 1] + 1 and starts[ordinals[to] + 1] - starts[ordinals[at]] <= most:
                to += 1
            own = starts[ordinals[at] : ordinals[at] + to - at + 1] - starts[ordinals[at]]
            raw = memoryview(self.range(int(starts[ordinals[at]]), int(starts[ordinals[to - 1] + 1])).tobytes())
            out[at:to] = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
            at = to
        return out

    def get(self, key: int | None, repeat: int = 0) -> np.ndarray | None:
        at = self.ordinals(np.array([key or 0]), np.array([key is None]), np.array([repeat]))[0]
        return None if at < 0 else self.ids(int(at))


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int, int]]:
    """Writes the shards; returns (name, documents, ids, ids before it) of each in key order. One entry a shard reaches the driver."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "token-store")
    slim = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("text"), F.xxhash64(text_col).alias("h"))
    ordered = slim.repartitionByRange(partitions_for(docs), "doc_id", "h").sortWithinPartitions("doc_id", "h")
    system, path = _file_system(folder)
    system.create_dir(path, recursive=True)
    schema = ", ".join(f"{name} {kind}" for name, kind in META.items()).replace("int64", "long")
    meta = scratch.write(ordered.select("doc_id", "text").mapInArrow(_writer(folder, tokenizer, end_id), schema), "meta")
    rows = sorted(meta.collect(), key=lambda r: r.shard)
    scratch.drop("meta")
    before = list(accumulate((r.n_ids for r in rows), initial=0))
    shards, skipped = [], 0
    for r, b, earlier in zip(rows, before, [None, *rows], strict=False):
        # Rows of the first key that lie in earlier shards.
        tied = earlier is not None and earlier.last_key == r.first_key
        skipped = (skipped if earlier.first_key == earlier.last_key else 0) + earlier.n_last if tied else 0
        own = {"name": r.name.rsplit("/", 1)[1], "n_docs": r.n_docs, "n_ids": r.n_ids, "before": b}
        shards.append(own | {"first_key": r.first_key, "last_key": r.last_key, "first_key_before": skipped})
    _put(f"{folder}/manifest.json", uuid.uuid4().hex, lambda out: out.write(json.dumps({"end_id": end_id, "shards": shards}).encode()) and None)
    return [(r.name, r.n_docs, r.n_ids, b) for r, b in zip(rows, before, strict=False)]


class Store:
    """A store opened by its folder. At most `open_shards` shards are held open."""

    def __init__(self, folder: str, open_shards: int = 32):
        system, path = _file_system(f"{folder}/manifest.json")
        with system.open_input_stream(path) as file:
            found = json.loads(file.read())
        self.folder, self.shards, self.end_id, self.most = folder, found["shards"], found["end_id"], open_shards
        self.lasts = [self._place(s["last_key"]) for s in self.shards]
        self.opened: OrderedDict[int, Shard] = OrderedDict()

    @staticmethod
    def _place(key: int | None) -> tuple:
        return (key is not None, key or 0)

    def shard(self, number: int) -> Shard:
        if number not in self.opened:
            self.opened[number] = Shard(f"{self.folder}/{self.shards[number]['name']}")
            if len(self.opened) > self.most:
                self.opened.popitem(last=False)[1].file.close()
        self.opened.move_to_end(number)
        return self.opened[number]

    def get(self, key: int | None, repeat: int = 0) -> np.ndarray | None:
        """The ids of the `repeat`-th row of a key, wherever it lies; None where the store has no such row."""
        if repeat < 0 or not self.shards:
            return None
        number = bisect_left(self.lasts, self._place(key))
        # Of the shards that begin with this key, the last one whose earlier rows do not reach `repeat`.
        low, high = number, len(self.shards)
        while high - low > 1:
            middle = (low + high) // 2
            if self.shards[middle]["first_key"] == key and self.shards[middle]["first_key_before"] <= repeat:
                low = middle
            else:
                high = middle
        if low >= len(self.shards):
            return None
        own = self.shards[low]
        return self.shard(low).get(key, repeat - (own["first_key_before"] if own["first_key"] == key else 0))


def lookup(keys: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids (array; null where the store has no such key) of each row of keys, the first row of a repeated key. Keys are dealt in
    ranges, so that a task opens neighbouring shards only."""

    def run(batches):
        import pyarrow as pa

        store = Store(folder)
        for batch in batches:
            # A slice of keys at a time, since a document may be long.
            for at in range(0, batch.num_rows, 256):
                own = batch.column(0).slice(at, 256)
                ids = [store.get(key) for key in own.to_pylist()]
                yield pa.RecordBatch.from_arrays([own, pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    wanted = keys.select(F.col(id_col).cast("long").alias("doc_id")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return wanted.mapInArrow(run, "doc_id long, ids array<long>")


def _reader(batches):
    import pyarrow as pa

    for batch in batches:
        for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard = Shard(name)
            for at in range(0, shard.n_docs, 4096):
                rows = slice(at, at + 4096)
                keys, nulls = shard.keys[rows], shard.nulls[rows]
                # a block may begin among the rows of one key
                back = at - int(np.searchsorted(shard.keys[~shard.nulls], keys[0])) - int(shard.nulls.sum()) if at and not nulls[0] else at
                repeats = repeats_of(keys, nulls)
                run = (keys == keys[0]) & (nulls == nulls[0])
                repeats = np.where(run, repeats + back, repeats) if at else repeats
                found = shard.ordinals(keys, nulls, repeats)
                if (found < 0).any():
                    raise ValueError(f"{name}: a key is missing from its own index")
                starts = shard.starts[found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64(), mask=nulls), pa.array(before + starts), pa.array(shard.starts[found + 1] - starts), pa.array(shard.checksums(found))],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_store(spark, store: str | list[tuple[str, int, int, int]]) -> DataFrame:
    """One row per document of a store (its folder, or the shards that write_store told), through its index: doc_id, start (ids before it
    in the store), n_tokens, ids_crc32."""
    shards = [(f"{store}/{s['name']}", s["n_docs"], s["n_ids"], s["before"]) for s in Store(store).shards] if isinstance(store, str) else store
    schema = "name string, before long"
    rows = spark.createDataFrame([(name, before) for name, _, _, before in shards], schema)
    rows = rows.repartition(max(1, len(shards))) if shards else rows
    return rows.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")
