"""URL verdicts: explicit host and path rules first, mined association rules for the rest.

FP-growth mines token combinations of labelled URLs together with their label; rules with
the label on the right side are kept above a confidence and a support. Tokens that occur in
the same labelled URLs are one item, as any of their combinations has the same counts: long
shared paths would otherwise give a rule for each subset of their segments. Each rule is
posted under its rarest item; URLs with the same tokens are matched once. DataFrame and Spark
ML operations only.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import same, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict, host and path of the explicit rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: A rule holds on this share of the labelled URLs, and is right in this share of its cases.
MIN_SUPPORT = 0.0005
MIN_CONFIDENCE = 0.5
_LABEL = "label="


def _parts(url: Column) -> tuple[Column, Column]:
    pattern = r"://([^/?#]*)([^?#]*)"
    body = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(body, pattern, 1), UPPER, LOWER), F.regexp_extract(body, pattern, 2)


def explicit(host: Column, path: Column, rules=RULES) -> Column:
    """Struct of the longest fitting rule's text and verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        hit = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit).otherwise(out)
    return out


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: host labels, path segments without digits, names in the query part."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(
        F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike("[0-9]")), lambda x: F.concat(F.lit("p:"), x)
    )
    names = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    found = F.filter(F.concat(labels, segments, names), lambda x: ~x.isin("h:", "q:"))
    return F.array_sort(F.array_distinct(found))


def token_classes(labelled: DataFrame) -> DataFrame:
    """`_token` and `_item`, the least of the tokens that occur in the same `_tokens` sets.

    The sets are compared by their number and by two hashes; a class is no larger than a URL.
    """
    held = labelled.select("_tokens").distinct().select(
        F.explode("_tokens").alias("_token"), F.xxhash64("_tokens").alias("_x"), F.xxhash64(F.lit("url"), "_tokens").alias("_y")
    )
    holders = held.groupBy("_token").agg(F.count("*").alias("_n"), F.bit_xor("_x").alias("_x"), F.bit_xor("_y").alias("_y"))
    classes = holders.groupBy("_n", "_x", "_y").agg(F.min("_token").alias("_item"), F.collect_list("_token").alias("_all"))
    return classes.select(F.explode("_all").alias("_token"), "_item")


def _with_items(token_sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct `_tokens` with `_parts`, their known tokens as pairs (item, token)."""
    sets = token_sets.select("_tokens").distinct()
    pairs = sets.select("_tokens", F.explode("_tokens").alias("_token")).join(classes, "_token")
    return pairs.groupBy("_tokens").agg(F.collect_list(F.struct("_item", "_token")).alias("_parts"))


def mine(
    labelled: DataFrame, classes: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """Rules (items, verdict, confidence, support) from `_tokens` and `_label` (block or allow)."""
    known = written(_with_items(labelled, classes).withColumnRenamed("_tokens", "_of"), "url-items")
    found = F.array_distinct(F.transform(F.coalesce("_parts", F.array()), lambda p: p["_item"]))
    baskets = labelled.join(known, F.col("_tokens") == F.col("_of"), "left").select(
        F.concat(found, F.array(F.concat(F.lit(_LABEL), "_label"))).alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    return model.associationRules.where(
        F.element_at("consequent", 1).startswith(_LABEL)
    ).select(
        F.array_sort("antecedent").alias("_need"),
        F.substring(F.element_at("consequent", 1), len(_LABEL) + 1, 100).alias("_verdict"),
        F.col("confidence").alias("_confidence"),
        F.col("support").alias("_support"),
    )


def match(token_sets: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """For each distinct `_tokens` the best matching rule's verdict: `_tokens`, `_mined`.

    A set has an item if it has any of its tokens. Best is by confidence, support, number of
    the set's tokens in the rule, then these tokens themselves.
    """
    wanted = rules.select(F.explode("_need").alias("_item")).distinct()
    sets = written(_with_items(token_sets, classes.join(wanted, "_item")), "url-sets").withColumn(
        "_items", F.array_distinct(F.transform("_parts", lambda p: p["_item"]))
    )
    used = sets.select(F.explode("_items").alias("_item")).groupBy("_item").agg(F.count("*").alias("_n"))
    needed = rules.select("*", F.explode("_need").alias("_item")).join(used, "_item")
    posted = needed.groupBy("_need", "_verdict", "_confidence", "_support").agg(
        F.min(F.struct("_n", "_item")).alias("_rarest")
    ).select("_need", "_verdict", "_confidence", "_support", F.col("_rarest._item").alias("_item"))
    candidates = sets.select("*", F.explode("_items").alias("_item")).join(posted, "_item")
    fit = candidates.where(F.size(F.array_except("_need", "_items")) == 0)
    fit = fit.withColumn("_has", F.array_sort(F.expr("transform(filter(_parts, p -> array_contains(_need, p._item)), p -> p._token)")))
    best = F.max_by("_verdict", F.struct("_confidence", "_support", F.size("_has"), "_has", "_verdict"))
    return fit.groupBy("_tokens").agg(best.alias("_mined"))


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules=RULES,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """The pages with `host`, `path`, `rule` and `verdict`.

    `labels` has page_id and `block` (Boolean); rows with a null in either are not used. A
    URL without a fitting explicit or mined rule is allowed. Null or odd URLs have empty host
    and path. Empty pages give an empty result; without usable labels nothing is mined.
    Repeated rows each get their verdict. Columns of the result's names are replaced.
    """
    host, path = _parts(F.col("url"))
    parts = pages.withColumns({"host": host, "path": path})
    parts = parts.withColumns(
        {"_tokens": tokens(F.col("host"), F.col("path"), F.col("url")), "_rule": explicit(F.col("host"), F.col("path"), rules)}
    )
    known = labels.where(F.col("block").isNotNull() & F.col("page_id").isNotNull()).select(
        F.col("page_id").alias("_id"), F.when(F.col("block"), "block").otherwise("allow").alias("_label")
    )
    learned = written(
        parts.select("page_id", "_tokens").join(known, F.col("page_id") == F.col("_id")).select("_tokens", "_label"),
        "url-labels",
    )
    verdicts = parts.select("*")
    if learned.isEmpty():
        verdicts = parts.withColumn("_mined", F.lit(None).cast("string"))
    else:
        classes = written(token_classes(learned), "url-classes")
        mined = written(mine(learned, classes, min_support, min_confidence), "url-rules")
        found = match(parts.where(F.col("_rule").isNull()), mined, classes)
        found = found.withColumnRenamed("_tokens", "_key")
        verdicts = parts.join(found, same(F.col("_tokens"), F.col("_key")), "left")
    return verdicts.withColumns(
        {
            "rule": F.col("_rule.rule"),
            "verdict": F.coalesce(F.col("_rule.verdict"), F.col("_mined"), F.lit("allow")),
        }
    ).drop("_tokens", "_rule", "_mined", "_key")
