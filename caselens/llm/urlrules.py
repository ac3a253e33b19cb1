"""URL filters: association-rule filtering. FP-growth mines combinations of URL tokens from labelled urls; rules pruned by support
and confidence match the other urls through an inverted index (each rule stands under its rarest token).

Static host/path rules come first and the longest one that fits decides; the mined rules judge the rest.

Rows: a null url, or one without "://", has an empty host and path, no tokens, and the default verdict. Repeated urls are judged
once and alike. Urls labelled both ways count under both labels. Of rules that fit one url the one with the highest confidence is
named, then the one with the fewest tokens, then the last in text order. A very long url has a token for each of its distinct
parts. Without labels, or without a rule that survives, every url that no static rule fits is allowed. Empty tables give an empty
result. Extra columns are not read.

Size: transactions are distinct (url, label) pairs, so copies of one url cannot make all its subsets frequent. The rule table is
bounded by `max_broadcast` rows before it is broadcast; a larger one goes through an ordinary join. What is found for the distinct
urls is written before it meets the pages, so that adaptive execution can split a url that many pages have."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import Scratch

BLOCK, ALLOW = "=block", "=allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def static_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of rules [(verdict, "host/path")] that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens: labels of the host, segments of the path with digits as #, names of query parameters, a fragment."""
    some = lambda xs, tag: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    host, path = host_of(url), path_of(url)
    query = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    segments = F.transform(F.split(path, "/"), lambda s: F.regexp_replace(s, "[0-9]+", "#"))
    names = F.transform(F.split(query, "&"), lambda q: F.substring_index(q, "=", 1))
    return F.array_distinct(F.concat(some(F.split(host, r"\."), "h:"), some(segments, "p:"), some(names, "q:")))


def mine(labelled: DataFrame, min_support: float = 0.001, min_confidence: float = 0.6, min_count: int = 5) -> DataFrame:
    """labelled: url, blocked (boolean). Rules: antecedent array<string>, confidence, support, n (count of matching urls)."""
    sets = labelled.where("url is not null and blocked is not null").select(tokens(F.col("url")).alias("t"), F.when(F.col("blocked"), BLOCK).otherwise(ALLOW).alias("label"), "url").distinct()
    sets = sets.where(F.size("t") > 0).select(F.concat("t", F.array("label")).alias("items"))
    n = sets.count()
    spark = labelled.sparkSession
    if not n:
        return spark.createDataFrame([], "antecedent array<string>, confidence double, support double, n long")
    support = max(min_support, min_count / n)
    if support > 1:
        return spark.createDataFrame([], "antecedent array<string>, confidence double, support double, n long")
    rules = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(sets).associationRules
    rules = rules.where((F.element_at("consequent", 1) == BLOCK) & ~F.array_contains("antecedent", ALLOW))
    return rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support", F.round(F.col("support") * n).cast("long").alias("n"))


def pruned(rules: DataFrame) -> DataFrame:
    """Rules without those that a shorter rule with at least their confidence already covers (per single token: cheap and exact)."""
    single = rules.where(F.size("antecedent") == 1)
    ones = single.select(F.element_at("antecedent", 1).alias("token"), F.col("confidence").alias("c"))
    several = rules.where(F.size("antecedent") > 1)
    covered = several.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(ones, "token").where("c >= confidence").select("antecedent").distinct()
    return several.join(covered, "antecedent", "left_anti").unionByName(single)


def matched(urls: DataFrame, rules: DataFrame, max_broadcast: int = 100_000) -> DataFrame:
    """urls: url, t (tokens), distinct. Returns url, confidence, antecedent of its best rule, for urls that one matches."""
    lifted = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token"))
    often = lifted.groupBy("token").agg(F.count(F.lit(1)).alias("in_rules"))
    index = lifted.join(often, "token").groupBy("antecedent").agg(F.max("confidence").alias("confidence"), F.min_by("token", F.struct("in_rules", "token")).alias("token"))
    if rules.count() <= max_broadcast:
        index = F.broadcast(index)
    hits = urls.select("url", "t", F.explode("t").alias("token")).join(index, "token").where(F.size(F.array_except("antecedent", "t")) == 0)
    best = F.max(F.struct("confidence", F.expr("-size(antecedent)").alias("shorter"), "antecedent"))
    return hits.groupBy("url").agg(best.alias("best")).select("url", "best.confidence", "best.antecedent")


def judge(pages: DataFrame, labelled: DataFrame, static: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, confidence and antecedent of the mined rule that blocked it."""
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rule, verdict = static_rule(F.col("host"), F.col("path"), static)
    rows = rows.withColumns({"host": host_of(url), "path": path_of(url)}).withColumns({"rule": rule, "fixed": verdict})
    scratch = Scratch(pages.sparkSession, "urls")
    rules = scratch.write(pruned(mine(labelled, **options)), "rules")
    rest = rows.where("rule is null and url is not null").select("url", tokens(url).alias("t")).distinct()
    hits = scratch.write(matched(rest, rules), "hits")
    out = rows.join(hits, "url", "left")
    mined = F.when(F.col("rule").isNull() & F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("fixed", mined).alias("verdict"), F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"), F.when(F.col("rule").isNull(), F.col("antecedent")).alias("antecedent"))
