"""Jumping ahead in the stream of the generator behind Python's random module, so that tasks draw different pieces of one stream.

Its words follow a linear recurrence over two elements. With p its characteristic polynomial, x**n mod p says which of the first 19,937
words have to be added to give the n-th one; 624 words in a row are a state. p is found from the words themselves (Berlekamp and Massey);
powers are taken by squaring, so a jump costs the same wherever it goes."""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

# Fixed values of the generator.
WORDS, MIDDLE, DEGREE = 624, 397, 19937
UPPER, LOWER, TWIST = np.uint32(0x80000000), np.uint32(0x7FFFFFFF), np.uint32(0x9908B0DF)


def stream(state: np.ndarray, n: int) -> np.ndarray:
    """The first n untempered words, of which the first 624 are the state."""
    out = np.zeros(max(n, WORDS), np.uint32)
    out[:WORDS] = state
    step = WORDS - MIDDLE
    for at in range(WORDS, len(out), step):
        m = min(step, len(out) - at)
        a, b = out[at - WORDS : at - WORDS + m], out[at - WORDS + 1 : at - WORDS + 1 + m]
        y = (a & UPPER) | (b & LOWER)
        out[at : at + m] = out[at - WORDS + MIDDLE : at - WORDS + MIDDLE + m] ^ (y >> np.uint32(1)) ^ ((y & np.uint32(1)) * TWIST)
    return out[:n]


@lru_cache(maxsize=1)
def polynomial() -> int:
    """The characteristic polynomial; bit i is the coefficient of x**i."""
    words = stream(np.array(random.Random(1).getstate()[1][:-1], np.uint32), 2 * DEGREE + 2 * WORDS)
    now, before, length, gap, seen = 1, 1, 0, 1, 0  # connection polynomials, constant term lowest; the newest bit of seen is its lowest
    for n, bit in enumerate((words[1 : 2 * DEGREE + 65] & np.uint32(1)).tolist()):
        seen = (seen << 1 | bit) & ((1 << (DEGREE + 2)) - 1)
        if (now & seen).bit_count() & 1:
            if 2 * length <= n:
                now, before, length, gap = now ^ (before << gap), now, n + 1 - length, 1
                continue
            now ^= before << gap
        gap += 1
    if length != DEGREE:
        raise ArithmeticError("the recurrence was not found")
    return int(bin(now)[2:].rjust(DEGREE + 1, "0")[::-1], 2)


def _reduced(a: int, low: list[int]) -> int:
    """a mod p, where p = x**DEGREE plus the powers in low."""
    mask = (1 << DEGREE) - 1
    while a >> DEGREE:
        high, a = a >> DEGREE, a & mask
        for e in low:
            a ^= high << e
    return a


def _power(n: int) -> int:
    """x**n mod p."""
    p = polynomial()
    low = [i for i in range(DEGREE) if p >> i & 1]
    out = 1
    for bit in bin(n)[2:]:
        out = _reduced(int("0".join(bin(out)[2:]), 2), low)  # squaring puts a zero between any two coefficients
        if bit == "1":
            out = _reduced(out << 1, low)
    return out


def jumped(state: np.ndarray, n: int) -> np.ndarray:
    """The state n words later."""
    if not n:
        return state
    use = np.flatnonzero(np.frombuffer(bin(_power(n))[2:].encode()[::-1], np.uint8) == ord("1"))
    words = np.lib.stride_tricks.sliding_window_view(stream(state, DEGREE + WORDS), WORDS)
    out = np.zeros(WORDS, np.uint32)
    for at in range(0, len(use), 2048):
        out ^= np.bitwise_xor.reduce(words[use[at : at + 2048]], axis=0)
    return out


def drawn_from(seed: int, n: int) -> np.random.RandomState:
    """A generator whose random_sample goes on where random.Random(seed) is after n calls of random()."""
    state = random.Random(seed).getstate()[1]
    if state[-1] != WORDS:
        raise ValueError("the generator has been used")
    out = np.random.RandomState()
    out.set_state(("MT19937", jumped(np.array(state[:-1], np.uint32), 2 * n), WORDS))
    return out
