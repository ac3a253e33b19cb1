"""Which texts hold which of a set of items verbatim, without comparing every text with every item.

An item that a text contains has its inner words (all but the first and the last) whole in that text. Each item is looked up by its
longest inner word: the words of the texts meet the items in an equal join, and only those pairs are searched for the item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]+"


def contained(texts: DataFrame, items: DataFrame, most_broadcast: int = 100_000) -> DataFrame:
    """key, text, item, needle where a text contains an item. texts: key, text, ...; items: item, needle.

    Items of fewer than three words have no inner word and are searched for everywhere. Items are broadcast up to `most_broadcast` of
    them; beyond that they meet the texts in an ordinary join. Null and empty items are in no text. Columns of texts beyond the first two
    are dropped."""
    key, text = texts.columns[:2]
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    wanted = items.select(F.col(items.columns[0]).alias("item"), F.col(items.columns[1]).alias("needle")).where("needle <> ''")
    words = F.split("needle", SPACE)
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    wanted = wanted.withColumn("word", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    small = wanted.count() <= most_broadcast
    hint = F.broadcast if small else (lambda frame: frame)
    met = rows.select("key", F.explode(F.array_distinct(F.split("text", SPACE))).alias("word")).join(hint(wanted.where("word is not null")), "word")
    met = met.select("key", "item", "needle").distinct()
    out = rows.join(met, "key").where(F.contains("text", "needle"))
    short = wanted.where("word is null").select("item", "needle")
    if not short.isEmpty():
        out = out.unionByName(rows.join(hint(short), F.contains("text", "needle")))
    return out.select("key", "text", "item", "needle").distinct()
