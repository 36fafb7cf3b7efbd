"""Url filters: given host and path rules, and association rules mined from their verdicts."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewell.llm.common import BROADCAST_ROWS, few, prepare, saved

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule (host, path, verdict) that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_items(host: Column, path: Column, url: Column) -> Column:
    """The distinct tokens of a url: host labels, path words and query names; runs of digits count as 0.

    Characters that no host or path needs are separators, so a token never holds a label mark.
    """
    def words(kind: str, text: Column, split: str) -> Column:
        parts = F.filter(F.split(F.regexp_replace(text, "[0-9]+", "0"), split), lambda x: x != "")
        return F.transform(parts, lambda x: F.concat(F.lit(f"{kind}:"), x))

    query = F.regexp_replace(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "=[^&]*", "")
    return F.array_distinct(F.concat(
        words("host", host, "[^0-9A-Za-z]+"), words("path", path, "[^0-9A-Za-z]+"),
        words("query", F.coalesce(query, F.lit("")), "[^0-9A-Za-z]+")))


def token_classes(baskets: DataFrame, support: float) -> DataFrame:
    """(token, class): frequent tokens; those in exactly the same baskets have the least of them as class.

    A token is known by two sums of hashes of the different baskets that hold it.
    """
    least = math.ceil(support * baskets.count())
    different = baskets.groupBy("items", "label").agg(F.count("*").alias("n"))
    tokens = different.select(
        F.explode(F.array_distinct("items")).alias("token"), "n", F.xxhash64("items", "label").alias("one"),
        F.xxhash64(F.lit(1), "label", "items").alias("two"))
    known = tokens.groupBy("token").agg(
        F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("one", "two"))
    ).filter(F.col("n") >= least)
    classes = known.groupBy("n", "one", "two").agg(F.collect_list("token").alias("tokens"))
    return saved(classes.select(F.explode("tokens").alias("token"), F.array_min("tokens").alias("class")), "url-tokens")


def mine_rules(baskets: DataFrame, support: float, confidence: float, classes: DataFrame | None = None) -> DataFrame:
    """(antecedent, label, confidence, support) from baskets (items, label) by FP-growth.

    Only rules whose consequent is a label; a longer rule is dropped if a shorter one for the same
    label, contained in it, is as confident. Rules of any length are found. Tokens in exactly the
    same baskets are one item, named by the least of them (``token_classes``): any of them says
    what all say, and the sets of a group of equal long baskets are not all formed.
    """
    classes = token_classes(baskets, support) if classes is None else classes
    sets = baskets.select("items").distinct().withColumn("token", F.explode("items")).join(few(classes), "token").groupBy(
        "items").agg(F.collect_set("class").alias("held"))
    transactions = baskets.join(few(sets, BROADCAST_ROWS // 10), "items", "left").select(F.concat(
        F.coalesce("held", F.array().cast("array<string>")), F.array(F.concat(F.lit("label:"), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(transactions)
    rules = model.associationRules.filter(
        F.col("consequent")[0].startswith("label:") & ~F.exists("antecedent", lambda x: x.startswith("label:"))
    ).select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 7, 1 << 20).alias("label"),
             "confidence", "support")
    rules = saved(rules, "url-rules")
    # Inverted index again: a rule's possible generalisations hold one of its items.
    wide = rules.withColumn("item", F.explode("antecedent"))
    narrow = rules.select(F.col("antecedent").alias("a"), F.col("label").alias("l"), F.col("confidence").alias("c"),
                          F.col("antecedent")[0].alias("item"))
    covered = wide.join(narrow, "item").filter(
        (F.col("l") == F.col("label")) & (F.col("c") >= F.col("confidence")) & (F.size("a") < F.size("antecedent"))
        & (F.size(F.array_except("a", "antecedent")) == 0)).select("antecedent", "label").distinct()
    return rules.join(covered, ["antecedent", "label"], "left_anti")


def match_rules(baskets: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """``baskets`` (items, ...) that hold a token of each class of a rule's antecedent, with their best rule's label.

    An inverted index lists each rule under its rarest class; a basket looks up its classes and
    checks the few rules listed there. Returned is the least token held of each class. The best rule
    is the most confident, then best supported, then longest, then first in order of its tokens and label.
    """
    indexed = rules.withColumn("i", F.explode("antecedent"))
    often = indexed.groupBy("i").count()
    key = indexed.join(often, "i").groupBy("antecedent", "label", "confidence", "support").agg(
        F.min(F.struct("count", "i")).alias("least"))
    key = key.withColumn("item", F.col("least.i")).drop("least")
    used = classes.join(often.select(F.col("i").alias("class")), "class", "left_semi")
    held = baskets.withColumn("token", F.explode("items")).join(few(used), "token").groupBy("items").agg(
        F.collect_list(F.struct("class", "token")).alias("held"))
    held = held.withColumn("in", F.array_distinct("held.class"))
    hits = held.withColumn("item", F.explode("in")).join(few(key), "item").filter(
        F.size(F.array_except("antecedent", "in")) == 0)
    own = F.array_sort(F.transform("antecedent", lambda c: F.array_min(
        F.transform(F.filter("held", lambda h: h["class"] == c), lambda h: h["token"]))))
    best = F.struct(-F.col("confidence"), -F.col("support"), -F.size("antecedent"), own.alias("antecedent"), "label")
    return hits.groupBy("items").agg(F.min(best).alias("best")).select(
        "items", F.col("best.label").alias("label"), F.col("best.antecedent").alias("antecedent"))


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
    support: float = 0.005, confidence: float = 0.9, default: str = "allow",
) -> DataFrame:
    """(id, host, path, rule, verdict, mined) of every row.

    Where a given rule fits, the longest one decides. The urls so decided are the labelled
    ones: FP-growth mines the token combinations that imply a verdict with ``support`` and
    ``confidence`` among them, and these mined rules judge all other urls; ``mined`` is the
    combination that did. A url that no rule reaches gets ``default``.

    Urls are first reduced to their different token sets with counts; a token set that very many
    urls share is then matched once. Mining sees every labelled url. Null urls and urls without
    "://" have an empty host and path, no tokens, and get the default.
    """
    prepare(pages.sparkSession)
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"),
                        F.when(url.contains("://"), url).alias("url"))
    rows = saved(rows.select("id", "host", "path", url_items(F.col("host"), F.col("path"), F.col("url")).alias("items"),
                             rule_of(F.col("host"), F.col("path"), rules).alias("given")), "urls")
    rows = rows.withColumn("items", F.array_sort(F.coalesce("items", F.array().cast("array<string>"))))
    labelled = rows.filter("given is not null").select("items", F.col("given.verdict").alias("label"))
    open_sets = rows.filter("given is null").select("items").distinct()
    if labelled.limit(1).count():
        classes = token_classes(labelled, support)
        mined = match_rules(open_sets, mine_rules(labelled, support, confidence, classes), classes)
    else:
        mined = open_sets.limit(0).withColumn("label", F.lit("")).withColumn("antecedent", F.col("items"))
    out = rows.join(few(mined, BROADCAST_ROWS // 10), "items", "left")
    return out.select(
        F.col("id").alias(id_col), "host", "path", F.col("given.rule").alias("rule"),
        F.coalesce("given.verdict", "label", F.lit(default)).alias("verdict"),
        F.when(F.col("given").isNull(), F.col("antecedent")).alias("mined"))
