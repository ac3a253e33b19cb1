"""Suffix-array dedup against a dictionary of all strings."""

import hashlib
import random

import numpy as np
import pytest

from caselens.llm import suffixes


def brute(rows, window):
    raws = [(i, (t or "").encode()) for i, t in rows]
    order = lambda i, raw: (i is None, i or 0, hashlib.sha256(raw).hexdigest())
    first = {}
    for i, raw in raws:
        for at in range(len(raw) - window + 1):
            s, place = raw[at : at + window], (order(i, raw), at)
            first[s] = min(first.get(s, place), place)
    out = []
    for i, raw in raws:
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - window + 1):
            if first[raw[at : at + window]] < (order(i, raw), at):
                gone[at : at + window] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(frame, window):
    return sorted((tuple(r) for r in suffixes.digest(frame, window).collect()), key=repr)


def pieces(seed):
    """Texts that share passages at all distances, with edits, overlaps, runs of one sign and periodic stretches."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde é") for _ in range(rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(10, 60))) for _ in range(8)]
    texts = []
    for _ in range(40):
        parts = [rng.choice(passages) if rng.random() < 0.6 else " ".join(word() for _ in range(12)) for _ in range(rng.randint(1, 6))]
        text = "".join(parts)
        if rng.random() < 0.5 and len(text) > 20:
            at = rng.randrange(len(text))
            text = text[:at] + "#" + text[at + 1 :]
        texts.append(text)
    texts += ["a" * 700, "a" * 650, "ab" * 300, "xyz" * 200 + "end", passages[0], passages[0], "", None, "short"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("window", [48, 100])
def test_equals_brute_force(spark, window):
    rows = list(enumerate(pieces(window)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(frame, window) == brute(rows, window)


def test_long_texts_in_blocks(spark, monkeypatch):
    """Parts of a long text meet shorter copies of it; a block may end anywhere."""
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, long[700:1500]), (2, long), (3, long + long), (4, long[:299]), (5, "z" + long[5:1000])]
    monkeypatch.setattr(suffixes, "BLOCK", 512)
    got = []
    for i, text in rows:  # in this process, so that the smaller block counts
        import pyarrow as pa

        column = pa.array([text])
        firsts = [(begin + f, n) for _, begin, o, d in suffixes.blocks(column, 100) for f, n in zip(*suffixes.anchored(o, d, 100)[1:3], strict=True)]
        got.append(sum(n for _, n in firsts))
        assert sorted(f + k for f, n in firsts for k in range(n)) == list(range(len(text) - 99))
    monkeypatch.undo()
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), 100) == brute(rows, 100)


def test_a_text_longer_than_a_block(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghijklmnop ") for _ in range(700_000))
    rows = [(1, long), (2, long), (3, long[123_456:500_001]), (4, long[:50] + "#" + long[51:])]
    got = {r[0]: r for r in found(spark.createDataFrame(rows, "doc_id long, text string"), 100)}
    assert [got[i][2:4] for i in (1, 2, 3)] == [(0, 0), (700_000, 1), (376_545, 1)]
    assert got[4][2:4] == (700_000 - 51, 1)


def test_rows_of_any_kind(spark, odd_docs, no_docs):
    assert suffixes.digest(no_docs).count() == 0 and suffixes.remove(no_docs).count() == 0
    rows = [(r.doc_id, r.text) for r in odd_docs.collect() if len(r.text or "") < 10_000]
    assert found(odd_docs.where("text is null or length(text) < 10000"), 100) == brute(rows, 100)
    kept = suffixes.remove(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_remove_keeps_other_columns(spark):
    text = " ".join(f"word{i}" for i in range(40))
    frame = spark.createDataFrame([(1, text, "x"), (2, f"before {text} behind", "y")], "doc_id long, text string, th string")
    rows = {r.doc_id: r for r in suffixes.remove(frame).collect()}
    assert rows[1].text == text and rows[2].text == "before  behind" and rows[2].th == "y"


def test_identifiers_depend_on_all_bytes():
    raw = np.frombuffer(bytes(range(200)), np.uint8)
    ids = suffixes.identifiers(raw, 100, 2)
    assert len(ids) == 101 and len(np.unique(ids)) == 101
    for at in range(100):
        other = raw[:100].copy()
        other[at] ^= 1
        assert suffixes.identifiers(other, 100, 2)[0] != ids[0]
    assert len(suffixes.identifiers(raw[:99], 100, 2)) == 0
