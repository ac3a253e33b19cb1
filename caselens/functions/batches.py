"""Arrow batches in pieces of bounded size. Spark hands a Python function 10,000 rows at once, however long their texts are; what a function
makes of a text (words, counts, rows) is many times larger, so it is made of one piece after the other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Bytes of texts and lists in a piece; a longer row is a piece of its own.
PIECE = 1 << 20


def pieces(batch, most: int = PIECE) -> Iterator:
    """Slices of a record batch, in order, each of about `most` bytes or one row."""
    import pyarrow as pa
    import pyarrow.compute as pc

    kinds, size = pa.types, np.full(batch.num_rows, 64)
    for column in batch.columns:
        if any(f(column.type) for f in (kinds.is_string, kinds.is_binary, kinds.is_large_string, kinds.is_large_binary)):
            size += pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        elif kinds.is_list(column.type) or kinds.is_large_list(column.type):
            size += 16 * pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.diff((np.cumsum(size) - size) // most)) + 1
    for low, high in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
        if high > low:
            yield batch.slice(low, high - low)


def frames(batches) -> Iterator:
    """pandas frames of the pieces of batches."""
    return (piece.to_pandas() for batch in batches for piece in pieces(batch))


def by_pieces(run: Callable, schema: str) -> Callable:
    """For mapInArrow: what `run` makes of pandas frames, given piece by piece. schema: its columns as DDL, texts, longs and booleans only."""
    names, kinds = zip(*[field.split() for field in schema.split(", ")], strict=True)

    def mapped(batches):
        import pyarrow as pa

        known = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
        own = pa.schema(list(zip(names, [known[kind] for kind in kinds], strict=True)))
        for frame in run(frames(batches)):
            yield pa.RecordBatch.from_pandas(frame, own, preserve_index=False)

    return mapped
