"""From records to a time-isolated corpus: eligibility, references, association groups, splits, duplicate collapse, catalogue, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions.text import content_key, contamination, dataset_value, length_bucket, period, pilot_rank, stable_rank, strip
from caselens.operators.graph import connected_components
from caselens.plans.scratch import Scratch

SPLITS = {1: "corpus", 2: "dev", 4: "test", 8: "missing_time"}


def require_unique(frame: DataFrame, *keys: str) -> DataFrame:
    """frame, or an error when two rows agree in the keys."""
    twice = frame.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated {', '.join(keys)}: {tuple(twice[0])[:-1]}")
    return frame


def eligibility(delete_flag: Column, invalid_type: Column, content: Column) -> Column:
    """The first reason against a record, null for an eligible one."""
    return (
        F.when(~dataset_value(delete_flag).eqNullSafe(F.lit("0")), F.lit("deleted_or_unknown_delete_flag"))
        .when(dataset_value(invalid_type) != "", F.lit("marked_invalid"))
        .when(dataset_value(content) == "", F.lit("empty_content"))
        .when(contamination(content).isNotNull(), F.lit("embedded_tabular_data"))
    )


def require_clean(frame: DataFrame, text_col: str) -> DataFrame:
    """frame, whose evaluation fails at a text that holds a table."""
    dirty = contamination(F.col(text_col)).isNotNull()
    return frame.withColumn(text_col, F.when(dirty, F.raise_error(F.lit("a text holds tabular data"))).otherwise(F.col(text_col)))


def references(frame: DataFrame, json_col: str) -> DataFrame:
    """frame with refs (sorted distinct array of (knowledge_id, label)) and ref_error (null when the JSON is fine or missing).

    Items must be objects with a number or text as type and as value and a text as label; one bad item spoils the row's list."""
    raw = dataset_value(F.col(json_col))
    parsed = F.try_parse_json(F.when(raw != "", raw))
    frame = frame.withColumns({"__raw": raw, "__v": parsed}).withColumn("__kind", F.schema_of_variant("__v"))
    items = F.when(F.col("__kind").startswith("ARRAY"), F.col("__v").cast("array<variant>"))
    kind = lambda x, path: F.schema_of_variant(F.try_variant_get(x, path, "variant"))
    text = lambda x, path: strip(F.try_variant_get(x, path, "string"))
    scalar = lambda k: k.isin("STRING", "BIGINT") | k.startswith("DECIMAL") | k.isin("DOUBLE", "FLOAT")
    good = lambda x: F.coalesce(scalar(kind(x, "$.type")) & scalar(kind(x, "$.value")) & (kind(x, "$.label") == "STRING") & (text(x, "$.value") != "") & (text(x, "$.label") != ""), F.lit(False))
    frame = frame.withColumn("__items", items)
    error = (
        F.when(F.col("__raw") == "", None).when(F.col("__v").isNull(), F.lit("invalid_reference_json")).when(F.col("__items").isNull(), F.lit("invalid_reference_list"))
        .when(~F.forall("__items", good), F.lit("invalid_reference_item"))
    )
    frame = frame.withColumn("ref_error", error)
    pair = lambda x: F.struct(F.concat(text(x, "$.type"), F.lit(":"), text(x, "$.value")).alias("knowledge_id"), text(x, "$.label").alias("label"))
    none = F.array().cast("array<struct<knowledge_id:string,label:string>>")
    refs = F.when(F.col("ref_error").isNull() & F.col("__items").isNotNull(), F.array_sort(F.array_distinct(F.transform("__items", pair)))).otherwise(none)
    return frame.withColumn("refs", refs).drop("__raw", "__v", "__kind", "__items")


def association_groups(records: DataFrame, keys: list[str], scratch: Scratch, id_col: str = "rid") -> DataFrame:
    """rid, group_id (smallest rid): records that share a non-empty value of any key are one group, through any chain.

    Each value points to its smallest rid, so a value held by many records makes a star and no pairs."""
    edges = None
    for key in keys:
        own = records.select(F.col(id_col).alias("b"), F.col(key).alias("k")).where("k is not null and k <> ''")
        # Written, so that adaptive execution can split the join at a value that many records hold.
        hub = scratch.write(own.groupBy("k").agg(F.min("b").alias("a")), f"hub-{key}")
        star = own.join(hub, "k").where("a <> b").select("a", "b")
        edges = star if edges is None else edges.unionByName(star)
    labels = connected_components(edges, scratch).withColumnRenamed("node", id_col)
    return records.select(id_col).join(labels, id_col, "left").select(id_col, F.coalesce("label", id_col).alias("group_id"))


def split_of(mask: Column) -> Column:
    out = F.lit("cross_period")
    for bit, name in SPLITS.items():
        out = F.when(mask == bit, F.lit(name)).otherwise(out)
    return out


def assign_splits(records: DataFrame, groups: DataFrame, id_col: str = "rid", period_col: str = "period") -> DataFrame:
    """records with group_id and split; a group of one period goes there, any mixture is cross_period."""
    joined = records.join(groups, id_col)
    # Written first, so that a group with a third of all rows can be split where rows meet its mask.
    masks = Scratch(records.sparkSession, "splits").write(joined.groupBy("group_id").agg(F.bit_or(period_col).alias("mask")), "masks")
    return joined.join(masks, "group_id").withColumn("split", split_of(F.col("mask"))).drop("mask")


def leakage(records: DataFrame, keys: list[str]) -> DataFrame:
    """key, value of everything that stands in more than one split; empty when splits are isolated."""
    out = None
    for key in keys:
        crossing = records.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(F.col(key).cast("string").alias("value"))
        crossing = crossing.agg(F.countDistinct("split").alias("splits")).where("splits > 1").select(F.lit(key).alias("key"), "value", "splits")
        out = crossing if out is None else out.unionByName(crossing)
    return out


def collapse(records: DataFrame, hash_col: str = "text_hash", id_col: str = "rid") -> DataFrame:
    """text_hash, rid: the smallest record of each text."""
    return records.groupBy(hash_col).agg(F.min(id_col).alias(id_col))


def corpus_links(corpus: DataFrame, records: DataFrame, citations: DataFrame) -> DataFrame:
    """Distinct (docid, knowledge_id): a text's citations from all of its records."""
    members = records.where("split = 'corpus'").select(F.col("rid").alias("member"), "text_hash")
    return corpus.withColumnRenamed("rid", "docid").join(members, "text_hash").join(citations.withColumnRenamed("rid", "member"), "member").select("docid", "knowledge_id").distinct()


def catalog_support(citations: DataFrame, records: DataFrame) -> DataFrame:
    """knowledge_id, label, support: in how many groups of the corpus each entry is cited under each label."""
    joined = citations.join(records.where("split = 'corpus'").select("rid", "group_id"), "rid")
    return joined.groupBy("knowledge_id", "label").agg(F.countDistinct("group_id").alias("support"))


def sample_groups(records: DataFrame, n: int, seed: int, id_col: str = "rid", key_col: str = "source_id") -> DataFrame:
    """One record of each group, the n of smallest hash of seed and key."""
    one = records.groupBy("group_id").agg(F.min_by(F.struct(*records.columns), id_col).alias("r")).select("r.*")
    return one.withColumn("__at", stable_rank(seed, F.col(key_col).cast("string"))).orderBy("__at", key_col).limit(n).drop("__at")


def select_pilot(records: DataFrame, size: int, seed: int, strict: bool = True) -> DataFrame:
    """Stratified pilot: of each category and length bucket the max(32, ceil(size / 8)) records of smallest hash, dealt out in turns
    over the sorted strata until there are `size`. records: source_id, source_row, content, category.

    Of equal texts the first row counts. The grouped limit runs below the shuffle, so a large stratum sends few rows."""
    cap = max(32, -(-size // 8))
    content = F.col("content")
    usable = records.where((strip(F.coalesce("source_id", F.lit(""))) != "") & (strip(F.coalesce(content, F.lit(""))) != "") & ~F.lower(strip(content)).isin("null", "nan") & contamination(content).isNull())
    usable = usable.select(strip(F.col("source_id")).alias("source_id"), "source_row", "content", F.sha2("content", 256).alias("content_sha256"), F.when(strip(F.coalesce("category", F.lit(""))) == "", "__missing__").otherwise(strip(F.col("category"))).alias("category"))
    first = usable.groupBy("content_sha256").agg(F.min_by(F.struct("source_id", "source_row", "content", "category"), "source_row").alias("r")).select("content_sha256", "r.*")
    ranked = first.withColumns({"length_bucket": length_bucket(F.length("content")), "rank": pilot_rank(seed, F.col("source_id"), F.col("content_sha256"))})
    within = Window.partitionBy("category", "length_bucket").orderBy("rank", "source_row")
    dealt = ranked.withColumn("turn", F.row_number().over(within)).where(F.col("turn") <= cap).orderBy("turn", "category", "length_bucket").limit(size)
    if strict and dealt.count() < size:
        raise ValueError("fewer records than the pilot needs")
    return dealt


def build_dataset(source: DataFrame, scratch: Scratch, dev_start: str = "2026-01-01", test_start: str = "2026-02-01") -> dict[str, DataFrame]:
    """The whole build. source: id, order_id, case_content, call_time, delete_flag, order_invalid_type, case_accord_type_one_name,
    knowledge_quote, source_row. Ids must be unique among all rows, excluded ones too."""
    require_unique(source, "id")
    judged = source.withColumn("reason", eligibility(F.col("delete_flag"), F.col("order_invalid_type"), F.col("case_content")))
    fine = references(judged.where("reason is null"), "knowledge_quote")
    fine = fine.select(
        F.col("source_row").alias("rid"), F.col("id").alias("source_id"), "source_row", dataset_value(F.col("order_id")).alias("order_id"), content_key(F.col("case_content")).alias("text_hash"),
        F.col("case_content").alias("content"), "call_time", dataset_value(F.col("case_accord_type_one_name")).alias("category"), period(dataset_value(F.col("call_time")), dev_start, test_start).alias("period"), "refs", "ref_error",
    )
    fine = scratch.write(fine, "eligible")
    records = scratch.write(assign_splits(fine, association_groups(fine, ["order_id", "text_hash"], scratch)), "records")
    if not leakage(records, ["order_id", "text_hash", "group_id"]).isEmpty():
        raise ValueError("splits share a key")
    citations = records.select("rid", F.explode("refs").alias("r")).select("rid", "r.knowledge_id", "r.label").distinct()
    corpus = collapse(records.where("split = 'corpus'"))
    return {
        "excluded": judged.where("reason is not null").groupBy("reason").count(), "records": records, "citations": citations, "corpus": corpus,
        "links": corpus_links(corpus, records, citations), "catalog": catalog_support(citations, records),
    }


def query_set(records: DataFrame, split: str, n: int, seed: int, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source_id, content, gold; one row of counts) of a split's sample."""
    sample = sample_groups(records.where(F.col("split") == split), n, seed).select("source_id", "content", F.array_distinct(F.transform("refs", lambda r: r.knowledge_id)).alias("gold"))
    known = catalog.select("knowledge_id").distinct()
    targets = sample.select("source_id", F.explode("gold").alias("knowledge_id")).join(known.withColumn("known", F.lit(1)), "knowledge_id", "left")
    counted = targets.agg(F.count(F.lit(1)).alias("targets"), F.coalesce(F.sum("known"), F.lit(0)).alias("in_catalog"))
    stats = sample.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.size("gold") > 0).alias("labeled"), F.count_if(F.size("gold") == 0).alias("unlabeled")).crossJoin(F.broadcast(counted))
    return sample, stats.withColumn("unseen", F.col("targets") - F.col("in_catalog"))
