import hashlib
import re
import zlib

from pyspark.sql import functions as F

from caselens.llm import exact, queries, sharding


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(normal(r.text), []).append(r.doc_id)
    out = []
    for r in rows:
        ids = groups[normal(r.text)]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((r.doc_id, keep, len(ids), r.doc_id == keep, hashlib.sha256(normal(r.text).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups_match_brute_force(spark, sf, odd_docs):
    for docs in (odd_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        got = [tuple(r) for r in exact.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
        assert sorted(got, key=repr) == expected(docs.collect())


def test_colliding_hashes_are_told_apart(odd_docs):
    weak = lambda norm: F.substring(F.unhex(F.md5(norm)), 1, 0)  # noqa: E731  every text collides
    got = [tuple(r) for r in exact.exact_groups(odd_docs, hash_of=weak).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=repr) == expected(odd_docs.collect())


def test_dedup_keeps_one_row_and_all_columns(odd_docs, no_docs, spark, sf):
    kept = exact.exact_dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [normal(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({normal(r.text) for r in odd_docs.collect()})
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {k for _, k, *_ in expected(docs.collect())}
    assert sorted(r.doc_id for r in exact.exact_dedup(docs).collect()) == sorted(want)
    assert exact.exact_groups(no_docs).count() == exact.exact_dedup(no_docs).count() == 0


def check_shards(rows, docs, n):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id is not None) == sorted(
        (d.doc_id, len((d.text or "").encode()) + 8, zlib.crc32((d.text or "").encode())) for d in docs if d.doc_id is not None
    )
    assert len(rows) == len(docs)
    sizes = [0] * n
    for s in range(n):
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        sizes[s] = sum(r.size for r in own)
    target, most = sum(sizes) / n, max(r.size for r in rows)
    assert all(abs(x - target) <= most for x in sizes)
    ordered = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size))
    assert [r.shard for r in ordered] == sorted(r.shard for r in rows)


def test_shards_are_contiguous_and_balanced(spark, sf, odd_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check_shards(queries.op1_sharding(spark, sf).collect(), docs.collect(), 24)
    check_shards(sharding.shard_by_bytes(odd_docs, 3).collect(), odd_docs.collect(), 3)


def test_no_rows_and_written_shards(spark, sf, no_docs, tmp_path):
    assert sharding.shard_by_bytes(no_docs, 4).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sharding.write_shards(docs, f"{tmp_path}/s", 4)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == docs.count() and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
