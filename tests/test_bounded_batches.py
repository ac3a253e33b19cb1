"""What Python functions hold is bounded by a piece of a batch, not by Spark's batches of 10,000 rows."""

import tracemalloc

import pyarrow as pa
import pytest

from caselens.functions.batches import pieces
from caselens.operators import lexical


def _peak(run) -> int:
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def _texts(n: int):
    return pa.RecordBatch.from_pydict({"docid": list(range(n)), "text": [" ".join(f"w{i}x{j}" for j in range(200)) for i in range(n)]})


def test_pieces_are_the_batch():
    batch = pa.RecordBatch.from_pydict({"k": list(range(7)), "t": ["a" * 500, None, "b", "c" * 3000, "", "d" * 900, "e"], "l": [[1] * 90, [], None, [2], [3], [4], [5]]})
    parts = list(pieces(batch, 1500))
    assert len(parts) > 2 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert list(pieces(batch.slice(0, 0))) == [] and len(list(pieces(batch))) == 1


def test_terms_are_counted_in_pieces():
    """4,000 texts are 800,000 terms: over 100 MB if they are counted together."""
    batch = _texts(4000)
    out = []
    assert _peak(lambda: out.extend(x.num_rows for x in lexical._count(iter([batch])))) < 30e6
    assert sum(out) == 4000 and len(out) > 4


@pytest.mark.parametrize("wide", [1, 40])
def test_blocks_are_made_in_pieces(wide):
    """Strips that end in any piece, or go on over several, give the blocks of the whole batch."""
    n = 1200
    counted = pa.Table.from_batches(list(lexical._count(iter([_texts(n)])))).to_pydict()
    rows = pa.RecordBatch.from_pydict({"strip": [i // (8 * wide) for i in range(n)], **counted}, pa.schema([("strip", pa.int64()), ("docid", pa.int64()), ("dl", pa.int64()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int32()))]))
    made = list(lexical._blocks(200.0)(iter([rows])))
    got = {(t, s): n for b in made for t, s, n in zip(b["term"].to_pylist(), b["strip"].to_pylist(), b["n"].to_pylist(), strict=True)}
    assert got == {(f"w{i}x{j}", i // (8 * wide)): 1 for i in range(n) for j in range(200)}
    assert max(b.num_rows for b in made) < 200_000


def test_frames_of_lines_and_results_are_small():
    """Functions over lines and texts see at most a piece, however many rows Spark hands over."""
    from caselens.functions.batches import by_pieces
    from caselens.operators import extraction

    batch = pa.RecordBatch.from_pydict({"value": ["x" * 4000] * 2000})
    sizes = []

    def run(frames):
        import pandas as pd

        for frame in frames:
            sizes.append(len(frame))
            yield pd.DataFrame({"n": [len(frame)], "said": ["y"], "fine": [True]})

    out = list(by_pieces(run, "n long, said string, fine boolean")(iter([batch])))
    assert sum(sizes) == 2000 and max(sizes) < 300 and out[0].schema.names == ["n", "said", "fine"]
    texts = pa.RecordBatch.from_pydict({"content_sha256": [str(i) for i in range(3000)], "case_content": [f"one two three {'z' * 2000}"] * 2999 + ["one two"]})
    made = list(extraction._worker(extraction.LeadingWords, extraction.Contract("m"), lambda s: None)(iter([texts])))
    assert sum(b.num_rows for b in made) == 3000 and max(b.num_rows for b in made) < 1000
    assert made[-1]["error_code"][-1].as_py() == "UPSTREAM_RATE_LIMITED" and made[-1]["views"][-1].as_py() is None and made[0]["error_code"][0].as_py() is None


def test_nfkc_in_pieces(spark):
    from pyspark.sql import functions as F

    from caselens.functions.text import nfkc

    rows = spark.range(3000).select("id", F.concat(F.repeat(F.lit("Ａｂ１"), 300), F.col("id").cast("string")).alias("t")).unionByName(spark.createDataFrame([(-1, None), (-2, "plain")], "id long, t string"))
    got = {r.id: r.t for r in rows.select("id", nfkc(F.col("t")).alias("t")).collect()}
    assert got == {i: "Ab1" * 300 + str(i) for i in range(3000)} | {-1: None, -2: "plain"}


def test_l1_holds_few_differences():
    """The sums of a block are 8 MB; whole matrices of differences beside them are not."""
    import numpy as np

    from caselens.operators import dense

    draw = np.random.default_rng(3)
    q, v = draw.normal(size=(512, 16)), draw.normal(size=(2048, 16))
    got = []
    assert _peak(lambda: got.append(dense._l1_nearness(q, v))) < 10e6
    assert np.allclose(got[0][:5], -np.abs(q[:5, None] - v[None]).sum(2)) and dense._l1_nearness(q[:0], v).shape == (0, 2048) and dense._l1_nearness(q, v[:0]).shape == (512, 0)
