"""A bounded memory from words to ids that works on whole columns of words: each word is looked up by its 64-bit hash, compared byte by
byte, and its ids are gathered, all in numpy. Only words that are new reach the encoder.

Bound: when the remembered words fill half of the slots, or their bytes and ids exceed `most_bytes`, the memory starts anew with
the next column, so it holds `most_bytes` and the words of one column at most, however long those are."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of runs that begin at `starts`, one run after the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.zeros(0, np.int64)
    out = np.arange(ends[-1])
    out += np.repeat(starts - (ends - lengths), lengths)
    return out


class Pool:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.size = np.zeros(1024, dtype), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            grown = np.zeros(max(need, 2 * len(self.data)), self.data.dtype)
            grown[: self.size] = self.data[: self.size]
            self.data = grown
        self.data[self.size : need] = values
        self.size = need


class WordMemory:
    """learn: gives the ids of each of a list of distinct words."""

    PROBES = 8

    def __init__(self, learn: Callable[[list[bytes]], list[np.ndarray]], dtype, slots: int = 1 << 21, most_bytes: int = 128 << 20):
        self.learn, self.dtype, self.slots, self.most_bytes = learn, dtype, slots, most_bytes
        self.clear()

    def clear(self) -> None:
        self.keys, self.entry, self.used = np.zeros(self.slots, np.uint64), np.full(self.slots, -1, np.int32), 0
        self.words, self.ids = Pool(np.uint8), Pool(self.dtype)
        self.word_start, self.word_length, self.id_start, self.id_length = (Pool(np.int64) for _ in range(4))

    def _first_slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(self.slots - 1)).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 for new ones. Slots are never freed one by one, so a free slot ends the search."""
        at = self._first_slot(hashes)
        out = self.entry[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[at] != hashes))
        for _ in range(self.PROBES - 1):
            if not len(open_):
                return out
            at[open_] = (at[open_] + 1) & (self.slots - 1)
            out[open_] = self.entry[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[at[open_]] != hashes[open_])]
        out[open_] = -1
        return out

    def _place(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        """Remembers distinct new hashes; those that find no slot are forgotten after this column."""
        at = self._first_slot(hashes)
        for _ in range(self.PROBES):
            free = np.flatnonzero(self.entry[at] < 0)
            slots, first = np.unique(at[free], return_index=True)
            mine = free[first]
            self.keys[slots], self.entry[slots] = hashes[mine], entries[mine]
            self.used += len(slots)
            rest = np.ones(len(at), bool)
            rest[mine] = False
            hashes, entries, at = hashes[rest], entries[rest], (at[rest] + 1) & (self.slots - 1)
            if not len(at):
                return

    def _add(self, words: list[bytes]) -> np.ndarray:
        """New entries for words, which must be distinct."""
        ids = self.learn(words)
        numbers = self.word_start.size + np.arange(len(words), dtype=np.int32)
        for values, pool, starts, lengths in (([np.frombuffer(b"".join(words), np.uint8)], self.words, self.word_start, self.word_length), (ids, self.ids, self.id_start, self.id_length)):
            sizes = np.array([len(x) for x in (words if pool is self.words else ids)], np.int64)
            starts.add(pool.size + np.cumsum(sizes) - sizes)
            lengths.add(sizes)
            pool.add(np.concatenate(values))
        return numbers

    def encode(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each); words are data[start:end], no two overlap."""
        if not len(hashes):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        if 2 * self.used > self.slots or self.words.size + self.ids.size * self.ids.data.itemsize > self.most_bytes:
            self.clear()
        text = lambda at: [data[a:b].tobytes() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        entry = self._find(hashes)
        new = np.flatnonzero(entry < 0)
        if len(new):
            distinct, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            numbers = self._add(text(new[first]))
            self._place(distinct, numbers)
            entry[new] = numbers[back]
        lengths = ends - starts
        fits = self.word_length.data[entry] == lengths
        checked = np.where(fits, lengths, 0)
        differs = self.words.data[ragged(self.word_start.data[entry], checked)] != data[ragged(starts, checked)]
        if not fits.all() or differs.any():
            # Words that share their hash with another one are encoded by themselves.
            fits[np.searchsorted(np.cumsum(checked), np.flatnonzero(differs), "right")] = False
            odd = np.flatnonzero(~fits)
            own = text(odd)
            number = dict(zip(distinct_words := sorted(set(own)), self._add(distinct_words).tolist(), strict=True))
            entry[odd] = [number[w] for w in own]
        n = self.id_length.data[entry]
        return self.ids.data[ragged(self.id_start.data[entry], n)], n
