"""Cross-tokenizer alignment against a per-document brute force with the libraries."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from caselens.llm import alignment, queries

A, B = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


def byte_tokens(text):
    """[(id, bytes)] of A and of B, or two empty lists."""
    from tokenizers import Tokenizer
    import sentencepiece

    tok = byte_tokens.__dict__.setdefault("tok", Tokenizer.from_file(A))
    tok.encode_special_tokens = True
    model = byte_tokens.__dict__.setdefault("model", sentencepiece.SentencePieceProcessor(model_file=B))
    if not text:
        return [], []
    back = {c: b for c, b in alignment.byte_signs().items()}
    a = [(i, bytes(back[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in model.encode(text):
        piece = model.id_to_piece(i)
        b.append((i, bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace("\u2581", " ").encode()))
    raw = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])


def ranges(tokens):
    at = 0
    for i, raw in tokens:
        yield i, at, at + len(raw)
        at += len(raw)


def brute(texts):
    links, rows = [], []
    for text in texts:
        a, b = byte_tokens(text)
        ra, rb = list(ranges(a)), list(ranges(b))
        own, j = [], 0
        for i, s, e in ra:
            while j < len(rb) and rb[j][2] <= s:
                j += 1
            k = j
            while k < len(rb) and rb[k][1] < e:
                own.append((i, rb[k][0]))
                k += 1
        links.append(own)
        both = sorted({e for *_, e in ra} & {e for *_, e in rb})
        groups, left = [], [list(reversed(ra)), list(reversed(rb))]
        for end in both:
            sides = [[], []]
            for rest, side in zip(left, sides, strict=True):
                while rest and rest[-1][2] <= end:
                    side.append(str(rest.pop()[0]))
            groups.append("|".join(",".join(side) for side in sides))
        rows.append([len(a), len(b), len(both), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    docs = Counter(p for own in links for p in set(own))
    best = {}
    for (x, _), n in docs.items():
        best[x] = max(best.get(x, 0), n)
    return [(*r[:4], sum(docs[p] == best[p[0]] for p in own), sum(docs[p] for p in own), r[4]) for r, own in zip(rows, links, strict=True)]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a b", "a  b   c \n\n d\t e", "  lead and trail  ", "<|endoftext|> is text, <s> too </s>", "meta \u2581 sign", "nul \0 in it",
    "caf\u00e9 na\u00efve \u00fcber", "\u4e2d\u6587 \u3000 \u5b57 x", "\u00a0\u00a0 x \u2003 \u2028 y", "\U0001f600\U0001f601 z", "don't we'll I'VE 12345 6,789.00", "x" * 3000, "ab cd " * 500,
    "x\u0085 y", "x \u00a0 y", "caf\u00e9 noir", "a\r\n b\x0b c\x1c d", "a b", "a b",
]


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_equals_brute_force(spark, most):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("n_a", alignment.F.lit("clash")).repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align_digest(docs, A, B, most_pairs=most).collect()}
    assert [got[i] for i in range(len(ODD))] == brute(ODD)


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    got = queries.QUERIES["op11_cross_tokenizer_alignment"](spark, sf).toPandas().set_index("doc_id")
    want = brute([t for t in docs.text])
    assert [tuple(x) for x in got.loc[docs.doc_id, COLUMNS].itertuples(index=False)] == want


def test_rows_of_any_kind(spark, odd_docs, no_docs):
    assert alignment.align_digest(no_docs, A, B).count() == 0
    rows = alignment.align_digest(odd_docs, A, B).collect()
    assert len(rows) == odd_docs.count()
    assert all((r.n_links == 0) == (r.groups_sha256 == "") for r in rows)


def test_groups_spell_the_text(spark):
    docs = spark.createDataFrame([(1, "Some caf\u00e9 text, twice: caf\u00e9!"), (2, None)], "doc_id long, text string")
    rows = sorted(alignment.align(docs, A, B).collect(), key=lambda r: r.group)
    _, a_vocab = alignment.load_a(A)
    _, b_vocab = alignment.load_b(B)
    raw = " Some caf\u00e9 text, twice: caf\u00e9!".encode()
    for r in rows:
        assert a_vocab.spelled(np.array(r.a_ids)).tobytes() == b_vocab.spelled(np.array(r.b_ids)).tobytes() == raw[r.start : r.end]
    assert rows[-1].end == len(raw) and all(x.end == y.start for x, y in zip(rows, rows[1:]))


def test_memory_may_start_anew():
    """A memory too small for the texts gives the same groups."""
    texts = [f"word{i} and other{i % 7} things" for i in range(300)]
    column = [np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t) for t in texts])]
    large, small = alignment.Chunks(A, B), alignment.Chunks(A, B, slots=64, most_bytes=2000)
    for _ in range(3):
        want = [c.column(column[1], column[0]) for c in (large, small)]
        told = [[c.texts[i] for i in found.tolist()] for c, (found, _) in zip((large, small), want, strict=True)]
        assert told[0] == told[1]
