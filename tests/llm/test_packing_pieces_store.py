import random
import re
import zlib

import numpy as np
import pytest

from caselens.llm import packing, queries, sentpiece, tokenstore


def naive_pack(rows, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for n, source, cluster in rows:
        while n > capacity:
            bins.append([capacity, {source}, {cluster}])
            out.append((len(bins) - 1, capacity))
            n -= capacity
        fits = [(capacity - b[0], i) for i, b in enumerate(bins) if capacity - b[0] >= n and (source is None or source not in b[1]) and cluster not in b[2]]
        at = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([0, set(), set()])
        bins[at][0] += n
        bins[at][1].add(source)
        bins[at][2].add(cluster)
        out.append((at, n))
    return [b[0] for b in bins], out


def test_each_piece_goes_to_the_tightest_allowed_bin():
    chance = random.Random(5)
    for _ in range(30):
        rows = sorted(((chance.randint(0, 130), chance.choice([None, "a", "b", "c", "d"]), chance.randint(0, 12)) for _ in range(120)), key=lambda r: -r[0])
        got = packing.pack_rows(rows, 100)
        tight, bins = {}, {}
        for row, _, _, n, at, slot, _ in got:
            _, source, cluster = rows[row]
            open_ = {i: b for i, b in bins.items() if 100 - b[0] >= n and (source is None or source not in b[1]) and cluster not in b[2]}
            whole_piece = n == 100 and sum(1 for g in got if g[0] == row) > 1
            if at in bins:
                assert at in open_ and bins[at][0] == max(b[0] for b in open_.values())
            else:
                assert not open_ or whole_piece
            used, sources, clusters = bins.setdefault(at, [0, set(), set()])
            bins[at] = [used + n, sources | {source}, clusters | {cluster}]
            tight[at] = tight.get(at, 0) + n
        assert max(tight.values()) <= 100 and {at: u for *_, at, _, u in got} == tight
        assert abs(len(bins) - len(naive_pack(rows, 100)[0])) <= 3


def test_packing_keeps_every_word_and_no_conflict(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = packing.pack(docs, 300, group_rows=50).collect()
    length = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    pieces, bins = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append((r.start_word, r.n_words))
        bins.setdefault(r.bin, []).append(r)
    for d, own in pieces.items():
        assert [s for s, _ in sorted(own)] == [300 * i for i in range(len(own))] and sum(n for _, n in own) == length[d]
    assert set(pieces) == set(length)
    for own in bins.values():
        assert sum(r.n_words for r in own) == own[0].bin_words <= 300 and sorted(r.slot for r in own) == list(range(len(own)))
        assert len({r.source for r in own}) == len(own) == len({text[r.doc_id] for r in own})
    assert {r.doc_id for r in packing.pack(odd_docs).collect()} == {r.doc_id for r in odd_docs.collect()}
    assert packing.pack(no_docs).count() == 0


def test_rows_repeated_often_are_spread(spark):
    rows = [(1, "a b c", "s")] * 1500 + [(i, f"x y {i}", None) for i in range(2, 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = packing.pack(docs, 100, group_rows=200).collect()
    assert len(out) == len(rows)
    bins = {}
    for r in out:
        bins.setdefault(r.bin, []).append(r.doc_id)
    assert all(own.count(1) <= 1 for own in bins.values())
    groups = [b.split("-")[0] for b, own in bins.items() if 1 in own]
    assert len(set(groups)) > 5 and max(map(groups.count, groups)) < 500


def test_clusters_of_a_column(spark):
    docs = spark.createDataFrame([(i, f"t{i} x", f"s{i}", i % 3) for i in range(30)], "doc_id long, text string, source string, part int")
    bins = {}
    for r in packing.pack(docs, 10, cluster_col="part").collect():
        bins.setdefault(r.bin, []).append(r.doc_id % 3)
    assert all(len(set(own)) == len(own) for own in bins.values()) and len(bins) == 10


TEXTS = [
    "", " ", "  ", "Hello  world   x", " a", "ab  ", "日本語 テスト été \U0001f600\U0001f600x", "a\n\nb\tc", "don't 1234567 foo_bar(baz[0])=={}; https://x.y/z?q=1",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ABABABAB ababab", "x" * 300, "ﬁ ÀÉÎ ñ ß Ω ы न",
]


def test_piece_ids_are_the_librarys(spark, sf):
    from sentencepiece import SentencePieceProcessor

    path = queries.tokenizer_path("piece_bpe_32k.model")
    library, own = SentencePieceProcessor(model_file=path), sentpiece.Encoder(path)
    chance = random.Random(1)
    texts = TEXTS + ["".join(chance.choice("abcdefgh -éß\n.,1") for _ in range(chance.randint(1, 80))) for _ in range(300)]
    for text, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text), text
        assert own.decode(ids) == text
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op4_sentencepiece(spark, sf).collect():
        ids = np.array(library.encode(docs[r.doc_id]), "<u4")
        assert (r.n_ids, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(ids.tobytes()), True)


def test_unigram_viterbi_finds_the_best_sum():
    table = sentpiece.PieceTable(queries.tokenizer_path("piece_bpe_32k.model"))
    table.bpe = False
    table.scores = table.scores / 1000
    index = {p: i for i, p in enumerate(table.pieces)}
    for word in ["▁hello", "▁worldly", "▁zzqx", "▁internationalisation"]:
        best = {0: (0.0, [])}
        for end in range(1, len(word) + 1):
            options = [(best[s][0] + table.scores[index[word[s:end]]], [*best[s][1], index[word[s:end]]]) for s in range(end) if s in best and word[s:end] in index]
            best[end] = max(options, key=lambda o: o[0])
        got = table.segment([word])[0]
        assert sum(table.scores[i] for i in got) == pytest.approx(best[len(word)][0]) and "".join(table.pieces[i] for i in got) == word


def test_pieces_of_odd_and_no_rows(odd_docs, no_docs):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    got = sorted((r.doc_id or -1, r.decoded) for r in sentpiece.encode(odd_docs, path).collect())
    assert got == sorted((r.doc_id or -1, r.text or "") for r in odd_docs.collect())
    assert sentpiece.encode_digest(no_docs, path).count() == 0
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=path)
    want = []
    for d, t in [(r.doc_id, r.text or "") for r in odd_docs.collect()]:
        ids = np.array(library.encode(t), "<u4")
        want.append((d, len(ids), zlib.crc32(ids.tobytes()), True))
    assert sorted(map(tuple, sentpiece.encode_digest(odd_docs, path).collect()), key=repr) == sorted(want, key=repr)


def test_round_trip_is_false_where_the_meta_sign_is_lost(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "a\u2581b"), (2, "a b"), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.round_trip for r in sentpiece.encode_digest(docs, path).collect()} == {1: False, 2: True, 3: True}


def test_perfect_hash_is_minimal_and_tells_strangers():
    for n in (0, 1, 2, 63, 1000, 20_000):
        keys = tokenstore.key_hashes(np.arange(n), np.zeros(n, bool), np.zeros(n, np.int64))
        table = tokenstore.PerfectHash.build(keys)
        assert sorted(table.slots(keys).tolist()) == list(range(n))
    prints = np.zeros(n, np.uint32)
    prints[table.slots(keys)] = tokenstore.fingerprints(keys)
    strange = tokenstore.key_hashes(np.arange(n, 3 * n), np.zeros(2 * n, bool), np.zeros(2 * n, np.int64))
    slots = table.slots(strange)
    assert ((slots >= 0) & (prints[slots] == tokenstore.fingerprints(strange))).sum() == 0


def expected_store(rows, path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    start, out = 0, []
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_store_reads_back_what_the_tokenizer_gives(spark, sf):
    path = queries.tokenizer_path("word_bpe_49k.json")
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(tuple(r) for r in queries.op10_token_store(spark, sf).collect()) == expected_store(rows, path)
    texts = [*TEXTS, "<|endoftext|> It's can't.<|startoftext|>x", "A,b.C!d 12a a1 É,é. don't. 'S 's", "a\x1cb\x85c\xa0d e", "Σας ΣΑΣ, İI"]
    encoder = tokenstore.WordEncoder(path, most=40)
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_keyed_reads_of_odd_rows(spark, odd_docs, no_docs, tmp_path):
    path = queries.tokenizer_path("word_bpe_49k.json")
    shards = tokenstore.write_store(odd_docs, f"file://{tmp_path}/s", path)
    assert sum(s[1] for s in shards) == odd_docs.count()
    got = tokenstore.read_store(spark, shards).collect()
    assert len(got) == odd_docs.count() and sum(r.doc_id is None for r in got) == 2
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    encoder = tokenstore.WordEncoder(path)
    want = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id is not None}
    opened = [tokenstore.Shard(s[0]) for s in shards]
    for d, text in want.items():
        ids = next(x for x in (s.get(d) for s in opened) if x is not None)
        assert ids.tolist() == [*np.frombuffer(encoder.encode([(text or "").encode()])[0], "<u2").tolist(), 1]
    assert all(s.get(77_777) is None for s in opened) and any(s.get(1, 1) is not None for s in opened) and any(s.get(None, 1) is not None for s in opened)
    assert tokenstore.write_store(no_docs, f"file://{tmp_path}/n", path) == []
    assert tokenstore.read_store(spark, []).count() == 0


def test_packing_does_not_depend_on_how_the_files_lie(spark):
    rows = [(1, "a b c", "s")] * 500 + [(1, "a b c", None)] * 90 + [(i, f"x y {i}", f"s{i % 9}") for i in range(2, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, other = (sorted(packing.pack(d, 100, group_rows=100).collect(), key=repr) for d in (docs.coalesce(1), docs.repartition(7, "source", "text")))
    assert one == other and len(one) == len(rows)


def test_a_store_is_opened_by_its_folder(spark, no_docs, tmp_path):
    """One key on 400 texts lies in several shards; it is numbered through all of them."""
    path, folder = queries.tokenizer_path("word_bpe_49k.json"), f"file://{tmp_path}/store"
    rows = [(5, f"text number {i} of one key") for i in range(400)] + [(i, f"own {i}") for i in range(-20, 30) if i != 5] + [(None, f"no key {i}") for i in range(3)]
    shards = tokenstore.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), folder, path)
    store = tokenstore.Store(folder, open_shards=2)
    assert sum(s["first_key"] == 5 for s in store.shards) > 1 and len(store.shards) == len(shards)
    encoder = tokenstore.WordEncoder(path)

    def ids(text):
        return (*np.frombuffer(encoder.encode([text.encode()])[0], "<u2").tolist(), 1)

    got = [tuple(store.get(5, n).tolist()) for n in range(400)]
    assert sorted(got) == sorted(ids(t) for k, t in rows if k == 5)
    assert sorted(tuple(store.get(None, n).tolist()) for n in range(3)) == sorted(ids(t) for k, t in rows if k is None)
    assert all(tuple(store.get(k).tolist()) == ids(t) for k, t in rows if k not in (5, None))
    assert store.get(5, 400) is None and store.get(31) is None and store.get(-21) is None and store.get(0, 1) is None and store.get(None, 3) is None
    assert len(store.opened) <= 2
    assert sorted(tokenstore.read_store(spark, folder).collect(), key=repr) == sorted(tokenstore.read_store(spark, shards).collect(), key=repr)
    asked = spark.createDataFrame([(k,) for k in (7, -20, 99)], "doc_id long")
    assert {r.doc_id: r.ids and tuple(r.ids) for r in tokenstore.lookup(asked, folder).collect()} == {7: ids("own 7"), -20: ids("own -20"), 99: None}
    tokenstore.write_store(no_docs, f"file://{tmp_path}/none", path)
    assert tokenstore.Store(f"file://{tmp_path}/none").get(1) is None and tokenstore.read_store(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(FileNotFoundError):
        tokenstore.Store(f"file://{tmp_path}")
