import random
import re

import numpy as np
import pytest

from caselens.llm import common, wordmemory


def learned(words):
    return [np.frombuffer(w, np.uint8).astype(np.uint16)[: max(0, len(w) - 1)] for w in words]


@pytest.mark.parametrize("slots,most_bytes,bits", [(1 << 12, 1 << 20, 64), (16, 1 << 20, 64), (16, 40, 64), (1 << 8, 1 << 20, 3), (8, 64, 0)])
def test_ids_are_those_of_each_word(slots, most_bytes, bits):
    """Whatever fits into the memory, and even if different words have one hash."""
    chance = random.Random(slots + bits)
    memory = wordmemory.WordMemory(learned, np.uint16, slots, most_bytes)
    for _ in range(30):
        rows = ["".join(chance.choice("abé \n") for _ in range(chance.randint(0, 60))).encode() for _ in range(chance.randint(0, 6))]
        offsets, data = np.cumsum([0] + [len(r) for r in rows]), np.frombuffer(b"".join(rows), np.uint8)
        hashes, first, starts, ends = common.word_hashes(offsets, data)
        ids, n = memory.encode(hashes & np.uint64((1 << bits) - 1), starts, ends, data)
        words = [w for r in rows for w in re.findall(rb"[^\x20\x09-\x0D]+", r)]
        want = learned(words)
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x.tolist()]
        assert memory.words.size <= most_bytes + 2 * 6 * 120  # what it holds and the words of one column


def test_run_hashes_tell_words_apart():
    data = np.frombuffer(b"abcabcaabbcc", np.uint8)
    starts, lengths = np.array([0, 3, 6, 7, 8, 10]), np.array([3, 3, 1, 1, 1, 2])
    a = common.run_hashes(data, starts, lengths)
    assert a[0] == a[1] and a[2] == a[3] and len(set(a.tolist())) == 4
    assert wordmemory.ragged(np.array([5, 0]), np.array([2, 3])).tolist() == [5, 6, 0, 1, 2]
