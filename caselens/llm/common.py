"""What the training-data operators share: whitespace words, and a numpy kernel that hashes all words of an Arrow batch at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.plans.scratch import Scratch, delete  # noqa: F401  for the operators

#: Fixed by the contracts: words are runs of anything else.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """array<string> of the words of a text; empty for null."""
    return F.filter(F.split(whole(text), SPACE_RUN), lambda w: w != F.lit(""))


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space; empty for null."""
    return F.regexp_replace(whole(text), SPACE_RUN, " ")


def partitions_for(frame: DataFrame, each: int = 64 << 20) -> int:
    """How many partitions to deal a frame into: as many as the session says, more where its files hold more than `each` bytes a
    partition. Sources that do not tell their size count as empty."""
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    total = sum(s for s in sizes if s < 1 << 60)
    return max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // each))


# ---------------------------------------------------------------------------------------------- numpy word hashing

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 64)
        table = np.full(size, _BASE, np.uint64)
        table[0] = 1
        _powers = np.cumprod(table, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_slices(column, limit: int = 1 << 20):
    """Cuts an Arrow string column into (first row, byte offsets, bytes) of about `limit` bytes, at least one row each."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, len(column))
        yield at, offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]]
        at = to


def word_edges(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word of each row."""
    inside = ~_SPACE[data]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    edge[heads] = inside[heads]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:]
    feet = offsets[1:][offsets[1:] > 0] - 1
    tail[feet] = inside[feet]
    return np.flatnonzero(edge), np.flatnonzero(tail) + 1


def word_hashes(offsets: np.ndarray, data: np.ndarray, lower: bool = False):
    """(64-bit hash of each word, first word of each row plus the total, start and end byte of each word)."""
    if lower:
        data = LOWER[data]
    starts, ends = word_edges(offsets, data)
    return run_hashes(data, starts, ends - starts), np.searchsorted(starts, offsets), starts, ends


def run_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the runs of bytes, none of them empty and no two overlapping, in order of place."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power = _power_table(int(lengths.max()))
    heads = np.cumsum(lengths) - lengths
    position = np.arange(heads[-1] + lengths[-1]) - np.repeat(heads, lengths)
    used = position + np.repeat(starts, lengths)
    sums = np.add.reduceat((data[used].astype(np.uint64) + np.uint64(1)) * power[position], heads)
    return mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """64-bit hash of every run of n hashes (len - n + 1 of them); runs across rows are the caller's to leave out."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    factors = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(2 * seed + 1)) | np.uint64(1)
    out = hashes[:count] * factors[0]
    for i in range(1, n):
        out += hashes[i : i + count] * factors[i]
    return mix(out)
