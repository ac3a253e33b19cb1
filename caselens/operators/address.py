"""Address search: an index of entities, relational division by the entities of a query, and ranked evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.functions.address import parsed_address, query_entities
from caselens.operators.lexical import top

RELAXED = ("building", "house_number")


def build_address_index(cases: DataFrame, id_col: str = "docid", text_col: str = "content") -> DataFrame:
    """docid, kind, normalized, text, start, end, address_group: the grouped entities of each case."""
    rows = cases.select(F.col(id_col).alias("docid"), F.explode(parsed_address(F.col(text_col))).alias("e"))
    return rows.select("docid", "e.*").where("address_group is not null")


def write_address_index(index: DataFrame, path: str) -> None:
    """Sorted by (kind, normalized), so that a reader skips the row groups of other entities."""
    index.repartition("kind", "normalized").sortWithinPartitions("kind", "normalized", "docid").write.parquet(path)


def required_frame(spark, queries: list[tuple[int, str]]) -> DataFrame:
    """query_id, kind, normalized, query_text: what each query asks for."""
    rows = [(q, e["kind"], e["normalized"], e["text"]) for q, text in queries if text.strip() for e in query_entities(text)]
    return spark.createDataFrame(rows, "query_id long, kind string, normalized string, query_text string")


def matching_groups(required: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, docid, address_group where one group of a case has every required entity (relational division)."""
    wanted = required.select("query_id", "kind", "normalized").distinct()
    need = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    have = wanted.join(index.select("kind", "normalized", "docid", "address_group").distinct(), ["kind", "normalized"])
    have = have.groupBy("query_id", "docid", "address_group").agg(F.count(F.lit(1)).alias("have"))
    return have.join(need, "query_id").where("have = need").select("query_id", "docid", "address_group")


def scope_of(required: DataFrame) -> DataFrame:
    """query_id, scope: how precise the required entities are."""
    has = lambda k: F.max((F.col("kind") == k).cast("int")) == 1
    rows = required.groupBy("query_id").agg(has("named_place").alias("place"), has("building").alias("building"), has("house_number").alias("house"))
    base = F.when(F.col("place"), "named_place").otherwise("road")
    return rows.select("query_id", F.when(F.col("building"), F.concat(base, F.lit("_and_building"))).when(F.col("house"), F.concat(base, F.lit("_and_house_number"))).when(F.col("place"), "named_place").otherwise("road_surface").alias("scope"))


def search_addresses(required: DataFrame, index: DataFrame, cases: DataFrame, limit: int = 50, allow_broader: bool = False) -> DataFrame:
    """query_id, docid, source_id, rank, scope, broader, evidence (kind, normalized, query_text, text, start, end): cases in order of
    source_id. With allow_broader, queries without a match are asked again without building and house number."""
    strict = matching_groups(required, index)
    matches, asked = strict.withColumn("broader", F.lit(False)), required.withColumn("broader", F.lit(False))
    if allow_broader:
        relaxable = required.where(F.col("kind").isin(*RELAXED)).select("query_id").distinct()
        open_ = required.join(relaxable, "query_id", "left_semi").join(strict.select("query_id").distinct(), "query_id", "left_anti").where(~F.col("kind").isin(*RELAXED))
        matches = matches.unionByName(matching_groups(open_, index).withColumn("broader", F.lit(True)))
        asked = asked.unionByName(open_.withColumn("broader", F.lit(True)))
    first = matches.groupBy("query_id", "docid", "broader").agg(F.min("address_group").alias("address_group"))
    ranked = top(first.join(cases.select("docid", "source_id"), "docid"), limit, "source_id")
    spans = ranked.join(asked.distinct(), ["query_id", "broader"]).join(index, ["docid", "address_group", "kind", "normalized"])
    spans = spans.groupBy("query_id", "docid", "source_id", "rank", "broader", "kind", "normalized", "query_text").agg(F.min(F.struct("start", "end", "text")).alias("s"))
    evidence = F.array_sort(F.collect_list(F.struct("s.start", "s.end", "kind", "normalized", "query_text", "s.text"))).alias("evidence")
    out = spans.groupBy("query_id", "docid", "source_id", "rank", "broader").agg(evidence)
    scopes = scope_of(asked.where("not broader")).withColumn("broader", F.lit(False))
    if allow_broader:
        scopes = scopes.unionByName(scope_of(asked.where("broader")).withColumn("broader", F.lit(True)))
    return out.join(scopes, ["query_id", "broader"]).withColumn("scope", F.when(F.col("broader"), F.concat(F.lit("broader_"), "scope")).otherwise(F.col("scope")))
