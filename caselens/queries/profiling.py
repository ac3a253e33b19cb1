"""Queries of the profiling, validation and text operators over the driver's tables, each with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens.functions import text as T
from caselens.operators import dataset, profile
from caselens.operators.containment import contained
from caselens.queries.retrieval import benchmark, documents, table


def eligibility_reasons(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    flag = F.when(F.col("toxic") == 1, "1").otherwise("0")
    reason = dataset.eligibility(flag, F.when(F.col("quality") == 0, "low"), F.col("text"))
    return rows.select(F.coalesce(reason, F.lit("eligible")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def json_refs(spark, sf_dir):
    """Events as citations: a list of one object made from type, the JSON number and the type again as label."""
    e = table(spark, sf_dir, "events")
    item = F.concat(F.lit('[{"type":0,"value":'), F.get_json_object("props", "$.k"), F.lit(',"label":"'), F.col("event_type"), F.lit('"}]'))
    raw = F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).when(F.col("event_id") % 7 == 1, F.lit("null")).when(F.col("event_id") % 7 == 2, F.lit('[{"type":true,"value":1,"label":"x"}]')).when(F.col("event_id") % 7 == 3, F.col("props")).otherwise(item)
    out = dataset.references(e.select("event_id", raw.alias("q")), "q")
    first = F.get("refs", F.lit(0))
    return out.select("event_id", first["knowledge_id"].alias("knowledge_id"), first["label"].alias("label"), "ref_error")


def json_census(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).when(F.col("event_id") % 5 == 1, F.lit("[1, 2")).when(F.col("event_id") % 5 == 2, F.lit("[]")).when(F.col("event_id") % 5 == 3, F.get_json_object("props", "$.k")).otherwise(F.col("props"))
    return profile.json_census(e.select(raw.alias("raw")), "raw")


def json_items(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    item = F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('","value":'), F.get_json_object("props", "$.k"), F.lit("}"))
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("["), item, F.lit(","), item, F.lit(",3]"))).when(F.col("event_id") % 4 == 1, F.lit("null")).when(F.col("event_id") % 4 == 2, F.lit("{}")).otherwise(F.lit("NaN"))
    return profile.json_items(e.select(raw.alias("raw")), "raw")


def column_profile(spark, sf_dir):
    return profile.column_profile(documents(spark, sf_dir), ["text", "lang", "source", "n_chars"])


def column_profile_customer(spark, sf_dir):
    return profile.column_profile(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment", "c_nationkey"])


def length_quantiles(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY length(text))").cast("long")
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), disc(0.5).alias("p50"), disc(0.95).alias("p95"), disc(0.99).alias("p99"))


def top_values(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "customer"), "c_mktsegment", 3).unionByName(profile.top_values(documents(spark, sf_dir), "source", 10))


def approx_distinct(spark, sf_dir):
    return profile.distinct_counts(table(spark, sf_dir, "events"), ["event_type"], ["user_id", "props"])


def date_profile(spark, sf_dir):
    return profile.date_profile(table(spark, sf_dir, "orders"), "o_orderdate")


def month_histogram(spark, sf_dir):
    return profile.month_histogram(table(spark, sf_dir, "orders"), "o_orderdate")


def duration_hist(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    return profile.duration_histogram(rows, "o_orderdate", "l_shipdate")


FACETS = {"status": ["o_orderstatus"], "priority": ["o_orderpriority"], "date": ["o_orderdate"], "both": ["o_orderstatus", "o_orderpriority"]}


def group_variation(spark, sf_dir):
    groups = profile.group_variation(table(spark, sf_dir, "orders"), "o_custkey", FACETS)
    return groups.select(F.col("key").cast("long").alias("o_custkey"), "row_count", *[f"{f}_variation" for f in FACETS])


def group_summary(spark, sf_dir):
    return profile.group_summary(profile.group_variation(table(spark, sf_dir, "orders"), "o_custkey", FACETS))


def group_sizes(spark, sf_dir):
    return profile.size_histogram(profile.group_variation(table(spark, sf_dir, "orders"), "o_custkey", FACETS))


def hierarchy_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.when(F.col("c_custkey") % 5 > 0, F.col("r_name")).alias("one"), F.when(F.col("c_custkey") % 7 > 0, F.col("n_name")).alias("two"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("three"))
    return profile.hierarchy(rows, ["one", "two", "three"]).groupBy("depth", "gap", "path").agg(F.count(F.lit(1)).alias("rows"))


def text_relation(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.when(F.col("conv_id") % 3 == 0, F.substring("text", 1, 5)).otherwise(F.col("text")).alias("next"))
    rows = c.select("conv_id", "turn", "text").join(after, ["conv_id", "turn"], "left")
    return rows.groupBy(profile.text_relation(F.col("text"), F.when(F.col("conv_id") % 3 == 0, F.substring("text", 1, 5)).otherwise(F.col("next"))).alias("relation")).agg(F.count(F.lit(1)).alias("rows"))


def pii_flags(spark, sf_dir):
    rows = documents(spark, sf_dir)
    return rows.select("doc_id", T.has_email(F.col("text")).alias("email"), F.col("text").rlike(r"(?U)\d{7,}").alias("long_number"), T.is_multiline(F.col("text")).alias("multiline"))


def redaction(spark, sf_dir):
    shown = T.safe_display(F.col("text"))
    kind = F.when(shown.startswith("<REDACTED"), shown).otherwise(F.lit("shown"))
    return documents(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("rows"))


def pii_counts(spark, sf_dir):
    return profile.pii_counts(documents(spark, sf_dir), ["text", "source"]).select("field", "email_rows")


def domain_violations(spark, sf_dir):
    out = profile.violations(table(spark, sf_dir, "lineitem"), {"l_returnflag": ["A", "N"], "l_linestatus": r"[OP]", "l_linenumber": r"[1-5]"})
    return out.groupBy("l_returnflag_violation", "l_linestatus_violation", "l_linenumber_violation", "any_violation").agg(F.count(F.lit(1)).alias("rows"))


def ordinal_compare(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    other = c.where("c_custkey % 10 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")))
    return profile.ordinal_compare(c, other, "c_custkey", ["c_name", "c_mktsegment"])


def ground_quotes(spark, sf_dir):
    """Code-point spans of every occurrence of a benchmark item in a document."""
    rows = contained(documents(spark, sf_dir).select("doc_id", "text"), benchmark(spark, sf_dir))
    rows = rows.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), F.explode(T.occurrences(F.col("text"), F.col("needle"))).alias("start"), F.length("needle").alias("n"))
    return rows.select("doc_id", "item_id", "start", (F.col("start") + F.col("n")).alias("end"))


def overlapping_occurrences(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.size(T.occurrences(F.col("text"), F.lit("an"))).alias("hits"))


def split_documents(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(T.split_document(1000)("text")).alias("n", "part")).select("doc_id", "n", "part.offset", F.length("part.text").alias("length"))


def length_buckets(spark, sf_dir):
    return documents(spark, sf_dir).groupBy(T.length_bucket(F.length("text")).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))


def shared_keywords(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    pair = rows.join(rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after")), ["conv_id", "turn"])
    return pair.select("conv_id", "turn", F.array_join(T.shared_keywords(T.tokens(F.col("text")), T.tokens(F.col("after"))), " ").alias("keywords"))


def safe_cells(spark, sf_dir):
    start = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" ="), "url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("@"), "url")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", T.safe_cell(start).alias("cell"))


QUERIES = {
    f.__name__: f
    for f in (
        eligibility_reasons, json_refs, json_census, json_items, column_profile, column_profile_customer, length_quantiles, top_values, approx_distinct, date_profile, month_histogram, duration_hist,
        group_variation, group_summary, group_sizes, hierarchy_paths, text_relation, pii_flags, redaction, pii_counts, domain_violations, ordinal_compare, ground_quotes, overlapping_occurrences,
        split_documents, length_buckets, shared_keywords, safe_cells,
    )
}

SCALAR = "('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE')"
NULLS = "('', 'null', 'none', 'nan', 'n/a', 'na')"
WS = r"'^\s+|\s+$'"
VARIED = "SELECT o_custkey, count(*) AS row_count, count(DISTINCT o_orderstatus) > 1 AS status_variation, count(DISTINCT o_orderpriority) > 1 AS priority_variation, count(DISTINCT o_orderdate) > 1 AS date_variation, count(DISTINCT o_orderstatus || chr(31) || o_orderpriority) > 1 AS both_variation FROM orders GROUP BY o_custkey"
#: Where the part of a text ends that begins at a place, in parts of 1000 signs.
LAST_MARK = r"length(regexp_replace(substring(text, {0} + 501, 500), '[^\n。！？；;]*$', ''))"
CUT = "CASE WHEN length(text) - {0} <= 1000 THEN length(text) WHEN " + LAST_MARK + " > 0 THEN {0} + 500 + " + LAST_MARK + " ELSE {0} + 1000 END::BIGINT"
EMAIL = r"(^|[^A-Za-z0-9_.+-])[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)+($|[^A-Za-z0-9_.-])"


def _columns(name: str, columns: list[str]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{c}' AS field, {c}::VARCHAR AS raw FROM {name}" for c in columns)
    return rf"""WITH r AS ({rows}), s AS (SELECT field, raw, regexp_replace(coalesce(raw, ''), {WS}, '', 'g') AS s FROM r), v AS (SELECT *, CASE WHEN lower(s) NOT IN {NULLS} THEN s END AS v FROM s)
        SELECT field, count(*) AS total, count_if(s = '')::BIGINT AS blank, count_if(s <> '' AND v IS NULL)::BIGINT AS null_literal, count(v) AS filled, count_if(v IS NOT NULL AND raw <> s)::BIGINT AS trimmed,
            count_if(regexp_matches(v, '[\n\r]'))::BIGINT AS multiline, count_if(regexp_matches(v, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]'))::BIGINT AS control, count_if(regexp_full_match(v, '[+-]?\d+'))::BIGINT AS integer_like,
            min(length(v)) AS min_length, max(length(v)) AS max_length, quantile_disc(length(v), 0.5) AS p50, quantile_disc(length(v), 0.95) AS p95, quantile_disc(length(v), 0.99) AS p99 FROM v GROUP BY field"""


SQL = {
    "eligibility_reasons": """SELECT CASE WHEN toxic = 1 THEN 'deleted_or_unknown_delete_flag' WHEN quality = 0 THEN 'marked_invalid' WHEN trim(text, E' \\t\\n\\r') = '' THEN 'empty_content' WHEN contains(text, chr(9)) THEN 'embedded_tabular_data' ELSE 'eligible' END AS reason, count(*) AS rows
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    "json_refs": f"""WITH r AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '{{broken' WHEN 1 THEN 'null' WHEN 2 THEN '[{{"type":true,"value":1,"label":"x"}}]' WHEN 3 THEN props
                ELSE '[{{"type":0,"value":' || json_extract_string(props, '$.k') || ',"label":"' || event_type || '"}}]' END AS raw FROM events),
        v AS (SELECT *, lower(trim(raw)) IN ('', 'null', 'none', 'nan', 'n/a') AS missing, json_valid(raw) AS fine FROM r), k AS (SELECT *, CASE WHEN fine THEN json_type(raw) END AS kind FROM v),
        i AS (SELECT *, CASE WHEN kind = 'ARRAY' THEN json_extract(raw, '$[*]') END AS items FROM k),
        g AS (SELECT *, list_filter(items, lambda x: NOT coalesce(json_type(x, '$.type') IN {SCALAR} AND json_type(x, '$.value') IN {SCALAR} AND json_type(x, '$.label') = 'VARCHAR' AND trim(json_extract_string(x, '$.value')) <> '' AND trim(json_extract_string(x, '$.label')) <> '', false)) AS bad FROM i),
        e AS (SELECT *, CASE WHEN missing THEN NULL WHEN NOT fine THEN 'invalid_reference_json' WHEN kind <> 'ARRAY' THEN 'invalid_reference_list' WHEN len(bad) > 0 THEN 'invalid_reference_item' END AS ref_error FROM g),
        f AS (SELECT *, CASE WHEN NOT missing AND ref_error IS NULL THEN list_sort(list_transform(items, lambda x: json_extract_string(x, '$.type') || ':' || json_extract_string(x, '$.value') || chr(31) || json_extract_string(x, '$.label')))[1] END AS first FROM e)
        SELECT event_id, split_part(first, chr(31), 1) AS knowledge_id, split_part(first, chr(31), 2) AS label, ref_error FROM f""",
    "json_census": f"""WITH r AS (SELECT CASE event_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN '[1, 2' WHEN 2 THEN '[]' WHEN 3 THEN json_extract_string(props, '$.k') ELSE props END AS raw FROM events),
        k AS (SELECT lower(trim(coalesce(raw, ''))) IN {NULLS} AS missing, json_valid(raw) AS fine, CASE WHEN json_valid(raw) THEN json_type(raw) END AS kind FROM r)
        SELECT unnest(CASE WHEN missing THEN ['missing'] WHEN NOT fine THEN ['invalid_json'] ELSE ['valid_json', CASE kind WHEN 'ARRAY' THEN 'root_list' WHEN 'OBJECT' THEN 'root_dict' WHEN 'VARCHAR' THEN 'root_str' WHEN 'BOOLEAN' THEN 'root_bool' WHEN 'NULL' THEN 'root_NoneType' WHEN 'DOUBLE' THEN 'root_float' ELSE 'root_int' END] END) AS kind, count(*) AS count FROM k GROUP BY 1""",
    "json_items": f"""WITH r AS (SELECT CASE event_id % 4 WHEN 0 THEN '[' || one || ',' || one || ',3]' WHEN 1 THEN 'null' WHEN 2 THEN '{{}}' ELSE 'NaN' END AS raw FROM (SELECT event_id, '{{"type":"' || event_type || '","value":' || json_extract_string(props, '$.k') || '}}' AS one FROM events)),
        k AS (SELECT CASE WHEN lower(trim(raw)) NOT IN {NULLS} THEN raw END AS raw FROM r), v AS (SELECT raw, json_valid(raw) AS fine, CASE WHEN json_valid(raw) THEN json_type(raw) END AS kind FROM k), i AS (SELECT *, CASE WHEN kind = 'ARRAY' THEN json_extract(raw, '$[*]') END AS items FROM v),
        o AS (SELECT *, list_filter(items, lambda x: json_type(x) = 'OBJECT') AS objects FROM i), n AS (SELECT *, list_filter(objects, lambda x: json_extract_string(x, '$.type') IS NOT NULL AND json_extract_string(x, '$.value') IS NOT NULL) AS named FROM o)
        SELECT count_if(raw IS NULL)::BIGINT AS missing, count_if(NOT fine)::BIGINT AS invalid_json, count_if(fine)::BIGINT AS valid_json, count_if(kind = 'NULL')::BIGINT AS json_null, count_if(kind NOT IN ('NULL', 'ARRAY'))::BIGINT AS non_list, count_if(kind = 'ARRAY')::BIGINT AS list_rows,
            coalesce(sum(len(items) - len(objects)), 0)::BIGINT AS malformed_items, coalesce(sum(len(objects) - len(named)), 0)::BIGINT AS items_missing_identity, coalesce(sum(len(named)), 0)::BIGINT AS items,
            coalesce(sum(len(named) - len(list_distinct(list_transform(named, lambda x: json_extract_string(x, '$.type') || chr(31) || json_extract_string(x, '$.value'))))), 0)::BIGINT AS duplicate_items_within_row,
            coalesce(sum(len(list_filter(named, lambda x: json_extract_string(x, '$.label') IS NULL))), 0)::BIGINT AS items_missing_label, count_if(len(named) > 0)::BIGINT AS rows_with_items FROM n""",
    "column_profile": _columns("documents", ["text", "lang", "source", "n_chars"]),
    "column_profile_customer": _columns("customer", ["c_name", "c_mktsegment", "c_nationkey"]),
    "length_quantiles": "SELECT role, count(*) AS n, quantile_disc(length(text), 0.5) AS p50, quantile_disc(length(text), 0.95) AS p95, quantile_disc(length(text), 0.99) AS p99 FROM conversations GROUP BY role",
    "top_values": "(SELECT c_mktsegment AS value, count(*) AS count FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3) UNION ALL (SELECT source, count(*) FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)",
    "date_profile": "SELECT count(*) AS total, count(o_orderdate) AS filled, count(o_orderdate) AS valid, 0::BIGINT AS invalid, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders",
    "month_histogram": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS count FROM orders GROUP BY 1",
    "duration_hist": "WITH s AS (SELECT epoch(l_shipdate)::BIGINT - epoch(o_orderdate)::BIGINT AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT CASE WHEN s < 0 THEN -1 WHEN s = 0 THEN 0 ELSE pow(2, floor(log2(s)))::BIGINT END AS bucket, count(*) AS count FROM s GROUP BY 1",
    "group_variation": VARIED,
    "group_summary": f"SELECT count(*) AS groups, sum(row_count)::BIGINT AS rows, count_if(row_count > 1)::BIGINT AS multirow_groups, coalesce(sum(row_count) FILTER (WHERE row_count > 1), 0)::BIGINT AS rows_in_multirow_groups, count_if(status_variation)::BIGINT AS status_variation, count_if(priority_variation)::BIGINT AS priority_variation, count_if(date_variation)::BIGINT AS date_variation, count_if(both_variation)::BIGINT AS both_variation FROM ({VARIED})",
    "group_sizes": f"SELECT row_count AS size, count(*) AS groups FROM ({VARIED}) GROUP BY 1",
    "hierarchy_paths": """WITH r AS (SELECT CASE WHEN c_custkey % 5 > 0 THEN r_name END AS a, CASE WHEN c_custkey % 7 > 0 THEN n_name END AS b, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
        d AS (SELECT *, CASE WHEN c IS NOT NULL THEN 3 WHEN b IS NOT NULL THEN 2 WHEN a IS NOT NULL THEN 1 ELSE 0 END AS depth FROM r)
        SELECT depth, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT < depth AS gap, CASE depth WHEN 0 THEN NULL ELSE array_to_string(list_transform([a, b, c][1:depth], lambda x: coalesce(x, '<MISSING>')), ' > ') END AS path, count(*) AS rows FROM d GROUP BY 1, 2, 3""",
    "text_relation": rf"""WITH p AS (SELECT c.conv_id, c.text, CASE WHEN c.conv_id % 3 = 0 THEN substring(c.text, 1, 5) ELSE n.text END AS goal FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1),
        v AS (SELECT regexp_replace(text, {WS}, '', 'g') AS c0, regexp_replace(goal, {WS}, '', 'g') AS g0 FROM p), w AS (SELECT CASE WHEN lower(c0) NOT IN {NULLS} THEN c0 END AS c, CASE WHEN lower(g0) NOT IN {NULLS} THEN g0 END AS g FROM v)
        SELECT CASE WHEN c IS NULL AND g IS NULL THEN 'both_missing' WHEN c IS NULL THEN 'content_missing_only' WHEN g IS NULL THEN 'goal_missing_only' WHEN c = g THEN 'exactly_equal' WHEN contains(c, g) THEN 'goal_contained_in_content' WHEN contains(g, c) THEN 'content_contained_in_goal' ELSE 'both_present_distinct' END AS relation, count(*) AS rows FROM w GROUP BY 1""",
    "pii_flags": rf"SELECT doc_id, regexp_matches(text, '{EMAIL}') AS email, regexp_matches(text, '\d{{7,}}') AS long_number, regexp_matches(text, '[\n\r]') AS multiline FROM documents",
    "pii_counts": rf"SELECT 'text' AS field, count_if(regexp_matches(text, '{EMAIL}'))::BIGINT AS email_rows FROM documents UNION ALL SELECT 'source', count_if(regexp_matches(source, '{EMAIL}'))::BIGINT FROM documents",
    "domain_violations": "SELECT l_returnflag NOT IN ('A', 'N') AS l_returnflag_violation, l_linestatus NOT IN ('O', 'P') AS l_linestatus_violation, l_linenumber NOT BETWEEN 1 AND 5 AS l_linenumber_violation, l_returnflag NOT IN ('A', 'N') OR l_linestatus NOT IN ('O', 'P') OR l_linenumber NOT BETWEEN 1 AND 5 AS any_violation, count(*) AS rows FROM lineitem GROUP BY 1, 2, 3, 4",
    "ordinal_compare": """SELECT 'c_name' AS field, count_if(c_custkey % 10 <> 0)::BIGINT AS compared, 0::BIGINT AS mismatches, count_if(c_custkey % 10 = 0)::BIGINT AS unavailable FROM customer UNION ALL
        SELECT 'c_mktsegment', count_if(c_custkey % 10 <> 0)::BIGINT, count_if(c_custkey % 10 <> 0 AND c_custkey % 4 = 0 AND c_mktsegment IS NOT NULL)::BIGINT, count_if(c_custkey % 10 = 0)::BIGINT FROM customer""",
    "ground_quotes": """WITH m AS (SELECT doc_id, item_id, d.text AS t, b.text AS q FROM documents d JOIN benchmark b ON contains(d.text, b.text)), p AS (SELECT *, unnest(range(1, length(t) - length(q) + 2)) AS i FROM m)
        SELECT doc_id, item_id, (i - 1)::INT AS start, (i - 1 + length(q))::INT AS "end" FROM p WHERE substring(t, i, length(q)) = q""",
    "overlapping_occurrences": "SELECT doc_id, len(list_filter(range(1, greatest(length(t), 1)::BIGINT), lambda i: substring(t, i, 2) = 'an'))::INT AS hits FROM (SELECT doc_id, text AS t FROM documents)",
    "redaction": rf"""SELECT CASE WHEN regexp_matches(text, '(^|\D)1[3-9]\d{{9}}(\D|$)') OR regexp_matches(text, '(^|\D)\d{{17}}[\dXx](\D|$)') OR regexp_matches(text, '{EMAIL}') THEN '<REDACTED_PII_LIKE>' WHEN regexp_matches(text, '\d{{7,}}') THEN '<REDACTED_LONG_NUMBER>'
        WHEN length(text) > 120 OR regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]') THEN '<REDACTED_UNSAFE_VALUE>' ELSE 'shown' END AS kind, count(*) AS rows FROM documents GROUP BY 1""",
    "split_documents": rf"""WITH RECURSIVE r AS (SELECT doc_id, text, 0 AS n, 0::BIGINT AS start, {CUT.format('0')} AS cut FROM documents UNION ALL SELECT doc_id, text, n + 1, cut, {CUT.format('cut')} FROM r WHERE cut < length(text))
        SELECT doc_id, n::INT AS n, start::INT AS "offset", (cut - start)::INT AS length FROM r""",
    "length_buckets": "SELECT CASE WHEN length(text) <= 50 THEN '01_le_50' WHEN length(text) <= 200 THEN '02_51_200' WHEN length(text) <= 500 THEN '03_201_500' WHEN length(text) <= 2000 THEN '04_501_2000' ELSE '05_gt_2000' END AS bucket, count(*) AS rows FROM documents GROUP BY 1",
    "shared_keywords": """WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM conversations)
        SELECT a.conv_id, a.turn, array_to_string(list_sort(list_distinct(list_intersect(a.t, b.t)))[1:10], ' ') AS keywords FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
    "safe_cells": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN ''' =' || url WHEN 1 THEN '''@' || url ELSE url END AS cell FROM pages",
}
