"""Privacy-aware profiling: column statistics, domains, text relations, dates, groups, hierarchies, JSON fields and a dictionary.

Every profile is one aggregate (or one per unpivoted column set) with conditional sums; values are shown only after redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.text import CONTROL, has_citizen_id, has_email, has_mobile, integer_like, iso_time, path_join, power_bucket, safe_display, semantic_value, strip

#: Which field may hold what; a list is an enumeration, a text a pattern for the whole value.
DOMAIN_RULES = {
    "case_public": ["是", "否"],
    "case_is_visit": ["是", "否"],
    "case_is_urgent": ["一般", "紧急", "非常紧急"],
    "info_protect": ["是", "否"],
    "hotspot": ["是", "否"],
    "delete_flag": r"[01]",
    "area_code": r"\d{6}",
    "order_status": r"\d+",
    "is_accuracy": r"[01]",
    "isOverTime": r"[01]",
    "isSignOverTime": r"[01]",
    "visitCount": r"\d+",
}


def unpivoted(frame: DataFrame, columns: list[str]) -> DataFrame:
    """field, raw: a row for each value of each column, in one scan."""
    return frame.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("raw")) for c in columns])).alias("x")).select("x.*")


def column_profile(frame: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: how many values are blank, null words, filled, trimmed, multi-line, with control signs, integer-like,
    and the exact discrete quantiles of the filled ones' lengths."""
    rows = unpivoted(frame, columns).withColumns({"s": strip(F.coalesce("raw", F.lit(""))), "v": semantic_value(F.col("raw"))})
    filled = F.col("v").isNotNull()
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY CASE WHEN v IS NOT NULL THEN length(v) END)").cast("long")
    return rows.groupBy("field").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("s") == "").alias("blank"), F.count_if((F.col("s") != "") & ~filled).alias("null_literal"), F.count_if(filled).alias("filled"),
        F.count_if(filled & (F.col("raw") != F.col("s"))).alias("trimmed"), F.count_if(filled & F.col("v").rlike(r"[\n\r]")).alias("multiline"),
        F.count_if(filled & F.col("v").rlike(CONTROL)).alias("control"), F.count_if(filled & integer_like(F.col("v"))).alias("integer_like"),
        F.min(F.length("v")).alias("min_length"), F.max(F.length("v")).alias("max_length"), disc(0.5).alias("p50"), disc(0.95).alias("p95"), disc(0.99).alias("p99"),
    )


def distinct_counts(frame: DataFrame, exact: list[str], approximate: list[str]) -> DataFrame:
    """field, distinct_values, method: exact for safe columns, a HyperLogLog sketch (precision 12) for the others and for whole rows."""
    every = exact + approximate
    row = F.concat_ws("\x1e", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in every])
    hll = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(12)))
    one = frame.agg(*[F.countDistinct(semantic_value(F.col(c).cast("string"))).alias(c) for c in exact], *[hll(semantic_value(F.col(c).cast("string"))).alias(c) for c in approximate], hll(row).alias("__row"))
    method = {c: "exact" for c in exact}
    return one.select(F.explode(F.array(*[F.struct(F.lit(c if c != "__row" else "<row>").alias("field"), F.col(c).alias("distinct_values"), F.lit(method.get(c, "hll")).alias("method")) for c in [*every, "__row"]])).alias("x")).select("x.*")


def top_values(frame: DataFrame, column: str, k: int = 20) -> DataFrame:
    """value, count of the most frequent values as they may be shown; values that look alike after redaction count together."""
    shown = safe_display(semantic_value(F.col(column).cast("string")))
    return frame.select(shown.alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(k)


def date_profile(frame: DataFrame, column: str) -> DataFrame:
    """One row: total, filled, valid, invalid, first, last. Texts count as filled unless they are null words, and as valid if they are ISO
    times; times are valid as they are."""
    texts = frame.schema[column].dataType.simpleString() == "string"
    filled = semantic_value(F.col(column)) if texts else F.col(column)
    time = iso_time(filled) if texts else filled
    rows = frame.select(filled.alias("f"), time.alias("t"))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count("f").alias("filled"), F.count("t").alias("valid"), F.count_if(F.col("f").isNotNull() & F.col("t").isNull()).alias("invalid"), F.min("t").alias("first"), F.max("t").alias("last"))


def month_histogram(frame: DataFrame, column: str) -> DataFrame:
    return frame.where(F.col(column).isNotNull()).groupBy(F.date_format(column, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("count"))


def duration_histogram(frame: DataFrame, start: str, end: str) -> DataFrame:
    """bucket, count: durations in seconds by power of two; -1 stands for negative ones."""
    seconds = F.unix_timestamp(F.col(end).cast("timestamp")) - F.unix_timestamp(F.col(start).cast("timestamp"))
    rows = frame.select(seconds.alias("s")).where("s is not null")
    return rows.groupBy(F.when(F.col("s") < 0, F.lit(-1).cast("long")).otherwise(power_bucket(F.col("s"))).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def group_variation(frame: DataFrame, key: str, facets: dict[str, list[str]]) -> DataFrame:
    """key, row_count and for each facet whether its fields differ within the key."""
    fields = {name: F.xxhash64(F.concat_ws("\x1f", *[F.coalesce(semantic_value(F.col(c).cast("string")), F.lit("<MISSING>")) for c in cs])) for name, cs in facets.items()}
    rows = frame.select(semantic_value(F.col(key).cast("string")).alias("key"), *[h.alias(name) for name, h in fields.items()]).where("key is not null")
    # More than one value in a key is the same as some row differing from the first: minimum and maximum tell it without a set.
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("row_count"), *[(F.min(n) != F.max(n)).alias(f"{n}_variation") for n in facets])


def group_summary(groups: DataFrame) -> DataFrame:
    flags = [c for c in groups.columns if c.endswith("_variation")]
    many = F.col("row_count") > 1
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"), F.count_if(many).alias("multirow_groups"), F.coalesce(F.sum(F.when(many, F.col("row_count"))), F.lit(0)).alias("rows_in_multirow_groups"), *[F.count_if(F.col(f)).alias(f) for f in flags])


def size_histogram(groups: DataFrame) -> DataFrame:
    return groups.groupBy(F.col("row_count").alias("size")).agg(F.count(F.lit(1)).alias("groups"))


def hierarchy(frame: DataFrame, levels: list[str]) -> DataFrame:
    """frame with depth (last level that has a value), gap (a value below a missing one) and path (null at depth 0)."""
    values = F.array(*[semantic_value(F.col(c).cast("string")) for c in levels])
    depth = F.coalesce(F.array_max(F.transform(values, lambda v, i: F.when(v.isNull(), F.lit(0)).otherwise(i + 1))), F.lit(0))
    out = frame.withColumns({"__levels": values, "depth": depth})
    return out.withColumns({"gap": F.size(F.filter("__levels", lambda v: v.isNotNull())) < F.col("depth"), "path": F.when(F.col("depth") > 0, path_join(F.col("__levels"), F.col("depth")))}).drop("__levels")


def text_relation(content: Column, goal: Column) -> Column:
    """How two texts relate, the first that holds of seven."""
    c, g = semantic_value(content), semantic_value(goal)
    return (
        F.when(c.isNull() & g.isNull(), "both_missing").when(c.isNull(), "content_missing_only").when(g.isNull(), "goal_missing_only").when(c == g, "exactly_equal")
        .when(F.contains(c, g), "goal_contained_in_content").when(F.contains(g, c), "content_contained_in_goal").otherwise("both_present_distinct")
    )


def violations(frame: DataFrame, rules: dict[str, list[str] | str]) -> DataFrame:
    """frame with <field>_violation for each rule and any_violation; missing values violate nothing."""
    flags = {}
    for field, rule in rules.items():
        v = semantic_value(F.col(field).cast("string"))
        fits = v.isin(rule) if isinstance(rule, list) else v.rlike(rf"(?U)\A(?:{rule})\z")
        flags[f"{field}_violation"] = F.coalesce(~fits, F.lit(False))
    out = frame.withColumns(flags)
    return out.withColumn("any_violation", F.array_contains(F.array(*[F.col(f) for f in flags]), True))


def row_flags(frame: DataFrame, rules: dict[str, list[str] | str], texts: list[str]) -> DataFrame:
    """violations with has_pii: whether any of the text columns holds personal data, once a row however many do."""
    found = F.lit(False)
    for c in texts:
        found = found | F.coalesce(has_mobile(F.col(c)) | has_citizen_id(F.col(c)) | has_email(F.col(c)), F.lit(False))
    return violations(frame, rules).withColumn("has_pii", found)


def column_difference(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """column, state (shared, removed or added) of the columns of two exports."""
    one, two = raw.columns, clean.columns
    rows = [(c, "shared" if c in two else "removed") for c in one] + [(c, "added") for c in two if c not in one]
    return raw.sparkSession.createDataFrame(rows, "column string, state string")


def prefix_compare(sample: DataFrame, source: DataFrame, ordinal: str) -> DataFrame:
    """One row: logical_records of the sample, header_matches, prefix_row_mismatches (rows of the sample that differ from the source's row of
    the same ordinal, or have none), is_exact_prefix."""
    header = sample.columns == source.columns
    fields = [c for c in sample.columns if c != ordinal]
    whole = lambda frame, name: frame.select(ordinal, F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(x for x in frame.columns if x != ordinal)]).alias(name))
    if len(fields) != len(source.columns) - 1:
        rows = sample.select(F.lit(False).alias("same"))
    else:
        rows = whole(sample, "one").join(whole(source, "two"), ordinal, "left").select(F.col("one").eqNullSafe(F.col("two")).alias("same"))
    wrong = F.count_if(~F.col("same"))
    return rows.agg(F.count(F.lit(1)).alias("logical_records"), F.lit(header).alias("header_matches"), wrong.alias("prefix_row_mismatches"), (F.lit(header) & (wrong == 0)).alias("is_exact_prefix"))


def pii_counts(frame: DataFrame, columns: list[str]) -> DataFrame:
    """field, rows with a mobile number, a citizen id, an e-mail address, or any of them."""
    rows = unpivoted(frame, columns).where("raw is not null").select("field", has_mobile(F.col("raw")).alias("m"), has_citizen_id(F.col("raw")).alias("i"), has_email(F.col("raw")).alias("e"))
    return rows.groupBy("field").agg(F.count_if("m").alias("mobile_rows"), F.count_if("i").alias("citizen_id_rows"), F.count_if("e").alias("email_rows"), F.count_if(F.col("m") | F.col("i") | F.col("e")).alias("pii_rows"))


def json_census(frame: DataFrame, column: str) -> DataFrame:
    """kind, count: missing, invalid_json, valid_json and root_<type> of a JSON field."""
    raw = semantic_value(F.col(column))
    rows = frame.select(raw.alias("raw"), F.schema_of_variant(F.try_parse_json(raw)).alias("k"))
    shape = (
        F.when(F.col("k").startswith("ARRAY"), "root_list").when(F.col("k").startswith("OBJECT"), "root_dict").when(F.col("k") == "STRING", "root_str").when(F.col("k") == "BOOLEAN", "root_bool")
        .when(F.col("k") == "VOID", "root_NoneType").when(F.col("k") == "BIGINT", "root_int").otherwise("root_float")
    )
    kinds = F.when(F.col("raw").isNull(), F.array(F.lit("missing"))).when(F.col("k").isNull(), F.array(F.lit("invalid_json"))).otherwise(F.array(F.lit("valid_json"), shape))
    return rows.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("count"))


def json_items(frame: DataFrame, column: str) -> DataFrame:
    """One row: the twelve counts of a field that should hold a list of objects with type, value and label."""
    raw = semantic_value(F.col(column))
    rows = frame.select(raw.alias("raw"), F.try_parse_json(raw).alias("v")).withColumn("k", F.schema_of_variant("v"))
    part = lambda x, path: semantic_value(F.coalesce(F.try_variant_get(x, path, "string"), F.lit("")))
    item = lambda x: F.struct(F.schema_of_variant(x).startswith("OBJECT").alias("ok"), part(x, "$.type").alias("t"), part(x, "$.value").alias("v"), part(x, "$.label").alias("l"))
    rows = rows.withColumn("items", F.when(F.col("k").startswith("ARRAY"), F.transform(F.col("v").cast("array<variant>"), item)))
    rows = rows.withColumn("named", F.filter("items", lambda x: x.ok & x.t.isNotNull() & x.v.isNotNull()))
    size = lambda c: F.coalesce(F.sum(F.when(F.col("items").isNotNull(), F.size(c))), F.lit(0))
    return rows.agg(
        F.count_if(F.col("raw").isNull()).alias("missing"), F.count_if(F.col("raw").isNotNull() & F.col("v").isNull()).alias("invalid_json"), F.count_if(F.col("v").isNotNull()).alias("valid_json"),
        F.count_if(F.col("k") == "VOID").alias("json_null"), F.count_if(F.col("v").isNotNull() & (F.col("k") != "VOID") & F.col("items").isNull()).alias("non_list"), F.count_if(F.col("items").isNotNull()).alias("list_rows"),
        size(F.filter("items", lambda x: ~x.ok)).alias("malformed_items"), size(F.filter("items", lambda x: x.ok & (x.t.isNull() | x.v.isNull()))).alias("items_missing_identity"),
        size(F.col("named")).alias("items"), (size(F.col("named")) - size(F.array_distinct(F.transform("named", lambda x: F.struct(x.t, x.v))))).alias("duplicate_items_within_row"),
        size(F.filter("named", lambda x: x.l.isNull())).alias("items_missing_label"), F.count_if(F.size("named") > 0).alias("rows_with_items"),
    )


def ordinal_compare(left: DataFrame, right: DataFrame, ordinal: str, fields: list[str]) -> DataFrame:
    """field, compared, mismatches, unavailable: two exports of one table side by side by ordinal; null equals null."""
    pair = left.select(ordinal, *[F.col(f).cast("string").alias(f"l_{f}") for f in fields], F.lit(1).alias("in_l")).join(right.select(ordinal, *[F.col(f).cast("string").alias(f"r_{f}") for f in fields], F.lit(1).alias("in_r")), ordinal, "full_outer")
    rows = pair.select("in_l", "in_r", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")).alias("same")) for f in fields])).alias("x"))
    both = F.col("in_l").isNotNull() & F.col("in_r").isNotNull()
    return rows.groupBy("x.field").agg(F.count_if(both).alias("compared"), F.count_if(both & ~F.col("x.same")).alias("mismatches"), F.count_if(~both).alias("unavailable"))


def field_dictionary(columns: DataFrame, catalog: DataFrame) -> DataFrame:
    """Column statistics with the eight semantic attributes of a catalogue (small, joined by broadcast); unmapped fields say so."""
    out = columns.join(F.broadcast(catalog), "field", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit("unmapped")) for c, kind in catalog.dtypes if c != "field" and kind == "string"})
