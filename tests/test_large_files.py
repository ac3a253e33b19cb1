"""Hashes of files that are no single value: streamed, bounded in memory, refused when the file changes."""

import hashlib
import tracemalloc

import pytest

from caselens.sources import files


def test_a_file_over_two_gigabytes(spark, tmp_path):
    """A sparse file, so that the test needs no disk; Spark could not hold it as one value."""
    size = (2 << 30) + 12_345
    path = tmp_path / "large.bin"
    with open(path, "wb") as f:
        f.write(b"head")
        f.truncate(size)
    want = hashlib.sha256(b"head")
    for at in range(4, size, 1 << 20):
        want.update(bytes(min(1 << 20, size - at)))
    got = files.file_hashes(spark, str(path)).first()
    assert (got.length, got.sha256) == (size, want.hexdigest())


def test_memory_is_bounded(tmp_path):
    path = tmp_path / "a.bin"
    with open(path, "wb") as f:
        f.truncate(300 << 20)
    tracemalloc.start()
    length, _ = files.streamed_sha256(path.as_uri())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert length == 300 << 20 and peak < 64 << 20


def test_streams_and_values_agree(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    for i in range(6):
        (tmp_path / "sub dir" / f"f {i}.txt").write_bytes(bytes([i]) * (1000 * i + 1))
    rows = lambda most: sorted(map(tuple, files.file_hashes(spark, f"{tmp_path}/sub dir", most).collect()))
    assert rows(2500) == rows(1 << 20) and len(rows(2500)) == 6


def test_a_file_that_changes(tmp_path, monkeypatch):
    path = tmp_path / "a.bin"
    path.write_bytes(b"x" * 100)
    monkeypatch.setattr(files, "PIECE", 10)
    real = hashlib.sha256

    class Growing:
        def __init__(self):
            self.inner, self.done = real(), False

        def update(self, piece):
            if not self.done:
                self.done = True
                with open(path, "ab") as f:
                    f.write(b"more")
            self.inner.update(piece)

        def hexdigest(self):
            return self.inner.hexdigest()

    monkeypatch.setattr(files.hashlib, "sha256", Growing)
    with pytest.raises(ValueError, match="changed"):
        files.streamed_sha256(path.as_uri())
