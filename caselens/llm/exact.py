"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups to exclude collisions.

Rows: null texts count as empty; texts are equal when they are identical after every run of [\\x20\\x09-\\x0D] became one
space. Null ids sort after all others (a group of null ids only has a null keep_id). Rows repeated with one id and text are
members of one group, each counted; `exact_dedup` keeps one of them, the one whose JSON has the smallest sha-256. A very long text is
hashed and compared whole. Empty tables give empty results. Extra columns, whatever their names, pass through `exact_dedup` and
never reach `exact_groups`.

Plan: a slim table (id, hash, sha-256) is written once; groups come from it with map-side combining, so a group of copies that
holds a third of all rows costs a task one row, and are written too. Both sides of the joins on the hash are then plain shuffles,
which adaptive execution splits when one hash is hot. Texts travel once, to the rows of groups of two or more; there the first and
the last text of each hash are compared, which map-side combining leaves of any number of copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import Scratch, normalised


def content_hash(norm: Column) -> Column:
    """128 bits of a normalised text, as 16 bytes."""
    return F.unhex(F.md5(norm))


def _resolved(docs: DataFrame, id_col: str, text_col: str, hash_of, scratch: Scratch):
    """(rows: id, h, sub, sha; groups: h, sub, keep_id, group_size). sub is empty, or the text where a hash collided."""
    norm = normalised(F.col(text_col))
    rows = scratch.write(docs.select(F.col(id_col).alias("doc_id"), hash_of(norm).alias("h"), F.unhex(F.sha2(norm, 256)).alias("sha")), "rows")
    groups = scratch.write(rows.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    shared = groups.where("group_size > 1").select("h", "keep_id")
    texts = docs.select(F.col(id_col).alias("doc_id"), hash_of(norm).alias("h"), norm.alias("norm"))
    members = scratch.write(texts.join(shared, "h"), "members")
    # Texts of one hash are all equal if the first and the last of them in byte order are.
    collided = members.groupBy("h").agg(F.min("norm").alias("first"), F.max("norm").alias("last")).where("first <> last").select("h")
    collided = scratch.write(collided, "collided")
    if collided.isEmpty():
        scratch.drop("members")
        return rows.withColumn("sub", F.lit("")), groups.withColumn("sub", F.lit(""))
    # A collision: the texts of such hashes are their own group keys.
    parted = members.join(collided, "h").select("doc_id", "h", F.col("norm").alias("sub"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    rows = scratch.write(rows.join(collided, "h", "left_anti").withColumn("sub", F.lit("")).unionByName(parted), "parted")
    scratch.drop("members")
    return rows, scratch.write(rows.groupBy("h", "sub").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "parted-groups")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, groups = _resolved(docs, id_col, text_col, hash_of, Scratch(docs.sparkSession, "exact"))
    return rows.join(groups, ["h", "sub"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """docs without the copies, with all columns as they were."""
    scratch = Scratch(docs.sparkSession, "exact")
    rows, groups = _resolved(docs, id_col, text_col, hash_of, scratch)
    sha = F.unhex(F.sha2(normalised(F.col(text_col)), 256))
    whole_rows = docs.select(F.col(id_col).alias("doc_id"), sha.alias("sha"), F.struct("*").alias("row"))
    if rows.groupBy("h", "sub", "doc_id").count().where("count > 1").isEmpty():
        dropped = rows.join(groups.where("group_size > 1"), ["h", "sub"]).where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
        gone = dropped.select("doc_id", "sha").distinct()
        same = whole_rows.doc_id.eqNullSafe(gone.doc_id) & (whole_rows.sha == gone.sha)
        return whole_rows.join(gone, same, "left_anti").select("row.*")
    # Some id stands with one text several times: one row of each group stays, the same one wherever this runs.
    kept = scratch.write(rows.join(groups, ["h", "sub"]).where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("sha", "keep_id").distinct(), "kept")
    own = whole_rows.join(kept, "sha").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    order = F.sha2(F.to_json("row", {"ignoreNullFields": "false"}), 256)
    return own.groupBy("sha").agg(F.min_by("row", order).alias("row")).select("row.*")
