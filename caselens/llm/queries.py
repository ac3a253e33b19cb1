"""The queries of the training-data operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.llm import alignment, exact, exponion, langid, minhash, packing, quality, sentpiece, sharding, substring, suffixes, tokenstore, urlrules
from caselens.llm.common import Scratch


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file of the installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), n_shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    model = langid.fit(docs.where(part != 1))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "rejected")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.assess(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


#: Fixed by the contract.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    blocked = ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked")
    labelled = pages.select(F.col("page_id").alias("doc_id"), "url").join(labels, "doc_id").select("url", blocked)
    return urlrules.judge(pages, labelled, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "confidence")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digest(table(spark, sf_dir, "documents"), window=35)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentpiece.encode_digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(table(spark, sf_dir, "documents"), n=3, percent=85, lower=True)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Scratch(spark, "ids").path("store")
    tokenstore.write_store(table(spark, sf_dir, "documents"), store, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return tokenstore.read_store(spark, store)


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64, seed=1).drop("scanned")


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"), window=100)


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding, op2_substring_dedup, op3_best_fit_packing, op4_sentencepiece, op5_exact_dedup, op6_language_id, op7_minhash_near_dedup,
        op8_quality_rules, op9_url_filters, op10_token_store, op11_cross_tokenizer_alignment,
        op12_centroid_clustering, op13_suffix_array_dedup,
    )
}



def _crc_steps() -> str:
    """The table of the reflected CRC-32, as SQL: what each value of a byte turns into."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return f"{table}::BIGINT[]"


def _static_rules() -> tuple[str, str]:
    """(rule, verdict) of the longest static rule that fits host and path, as SQL."""
    rows = []
    for verdict, rule in sorted(URL_RULES, key=lambda r: (-len(r[1]), r[1])):
        host, slash, rest = rule.partition("/")
        rows.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{rest}')", rule, verdict))
    return tuple("CASE " + " ".join(f"WHEN {r[0]} THEN '{r[i]}'" for r in rows) + " END" for i in (1, 2))


def _rounds(n: int) -> str:
    """n rounds of k-means over e(vec_id, row, v), from centroids c0(j, v), as common table expressions."""
    steps = []
    for i in range(n + 1):
        steps.append(f"""a{i} AS (SELECT row, vec_id, e.v, arg_min(j, [d, j]) AS j, min(d) AS d FROM (SELECT row, vec_id, e.v, j, list_sum(list_transform(range(1, 65), lambda x: (e.v[x] - c{i}.v[x]) * (e.v[x] - c{i}.v[x])))::BIGINT AS d FROM e, c{i}) AS e GROUP BY row, vec_id, e.v)""")
        if i < n:
            steps.append(f"""m{i} AS (SELECT j, list(q ORDER BY p) AS v FROM (SELECT j, p, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS q FROM (SELECT j, unnest(v) AS x, unnest(range(64)) AS p FROM a{i}) GROUP BY j, p) GROUP BY j)""")
            steps.append(f"c{i + 1} AS (SELECT j, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (j))")
    return ", ".join(steps)


def _subsets(tokens: str) -> str:
    return f"array_to_string(list_filter({tokens}, lambda x, i: (m >> (i - 1)) & 1 = 1), chr(31))"


SQL = {
    "op13_suffix_array_dedup": """
        WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS row, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
             p AS (SELECT row, doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT *, unnest(range(len(h) // 2 - 99)) AS i FROM d WHERE len(h) >= 200)),
             m AS (SELECT s, min((doc_id, i)) AS one FROM p GROUP BY s HAVING count(*) > 1),
             r AS (SELECT DISTINCT row, i FROM p JOIN m USING (s) WHERE (doc_id, i) > one),
             g AS (SELECT row, i, i > coalesce(lag(i) OVER (PARTITION BY row ORDER BY i), -200) + 100 AS fresh FROM r),
             n AS (SELECT row, i, sum(fresh::INT) OVER (PARTITION BY row ORDER BY i) AS span FROM g),
             u AS (SELECT row, span, min(i) AS a, max(i) + 100 AS b FROM n GROUP BY row, span),
             k AS (SELECT row, a, b, coalesce(lag(b) OVER (PARTITION BY row ORDER BY a), 0) AS z FROM u),
             c AS (SELECT row, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept FROM k JOIN d USING (row) GROUP BY row)
        SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN c USING (row)""",
    "op12_centroid_clustering": f"""
        WITH k AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
             e AS (SELECT *, row_number() OVER (ORDER BY vec_id, v) AS row FROM k),
             c0 AS (SELECT j, v FROM (SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS j FROM e) WHERE j < 16),
             {_rounds(3)},
             s AS (SELECT j, sum(d)::BIGINT AS s FROM a3 GROUP BY j)
        SELECT vec_id, j::INT AS cluster, d AS distance, s AS cluster_inertia, (SELECT sum(d)::BIGINT FROM a3) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256 FROM a3 JOIN s USING (j) JOIN c3 USING (j)""",
    "op9_url_filters": rf"""
        WITH a AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{urlrules.UPPER}', '{urlrules.LOWER}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
                          coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '') AS query FROM pages),
             t AS (SELECT *, list_sort(list_distinct(list_concat(list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
                          list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '#', 'g')),
                          list_transform(list_filter(list_transform(string_split(query, '&'), lambda x: split_part(x, '=', 1)), lambda x: x <> ''), lambda x: 'q:' || x)))) AS t FROM a),
             j AS (SELECT *, {_static_rules()[0]} AS rule, {_static_rules()[1]} AS fixed FROM t),
             l AS (SELECT DISTINCT url, t, quality = 0 OR toxic = 1 AS blocked FROM t JOIN labels ON doc_id = page_id WHERE url IS NOT NULL AND len(t) > 0),
             n AS (SELECT ceil(greatest(0.001::DOUBLE, 5::DOUBLE / count(*)) * count(*)) AS least FROM l),
             s AS (SELECT blocked, {_subsets('t')} AS part FROM (SELECT *, unnest(range(1, 1 << len(t))) AS m FROM l)),
             f AS (SELECT part, count_if(blocked) / count(*) AS confidence FROM s GROUP BY part HAVING count_if(blocked) >= (SELECT least FROM n) AND count_if(blocked) / count(*) >= 0.6),
             q AS (SELECT url, {_subsets('t')} AS part FROM (SELECT *, unnest(range(1, 1 << len(t))) AS m FROM (SELECT DISTINCT url, t FROM j WHERE rule IS NULL AND url IS NOT NULL))),
             h AS (SELECT url, max(confidence) AS confidence FROM q JOIN f USING (part) GROUP BY url)
        SELECT page_id, host, path, rule, coalesce(fixed, CASE WHEN confidence IS NULL THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN rule IS NULL THEN confidence END AS confidence FROM j LEFT JOIN h USING (url)""",
    "op1_sharding": f"""
        WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
             c AS (SELECT doc_id, len(b) + 8 AS size, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, ({_crc_steps()})[(xor(a, x) & 255) + 1]))) AS crc FROM b),
             o AS (SELECT *, row_number() OVER w AS row, (sum(size) OVER w)::BIGINT - size AS start, (sum(size) OVER ())::BIGINT AS total FROM c WINDOW w AS (ORDER BY doc_id NULLS FIRST, crc, size ROWS UNBOUNDED PRECEDING)),
             s AS (SELECT *, least(23, (2 * start + size) * 24 // (2 * total))::INT AS shard FROM o)
        SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY row) - 1 AS slot, NULL::INT AS grown_shard FROM s""",
    "op7_minhash_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda w: w <> '') AS w FROM documents),
             u AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM d),
             g AS (SELECT doc_id, n, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS long_one, CASE WHEN n < 3 AND i = 0 THEN word || coalesce(' ' || lead(word) OVER o, '') END AS short_one FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
             h AS (SELECT DISTINCT doc_id, coalesce(long_one, short_one) AS s FROM g WHERE coalesce(long_one, short_one) IS NOT NULL),
             z AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
             p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h a JOIN h b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
             e AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
             r AS (SELECT doc_id AS node, doc_id AS label FROM documents UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node WHERE r.label < e.b),
             k AS (SELECT node AS doc_id, min(label) AS component_id FROM r GROUP BY node)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM k LEFT JOIN z USING (doc_id)""",
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
             g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)""",
    "op2_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
             s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
             k AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS win FROM s),
             r AS (SELECT win FROM k GROUP BY win HAVING count(*) > 1),
             c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM k JOIN r USING (win)),
             g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
             o AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (doc_id))
        SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed,
               sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256 FROM o""",
}
