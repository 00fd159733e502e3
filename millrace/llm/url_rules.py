"""URL filters: explicit rules, and association rules that FP-growth mines from labelled URLs."""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import written

_VERDICT = "verdict="


@dataclass(frozen=True)
class SiteRule:
    """A verdict for a host with all its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    SiteRule("allow", "org", "/"),
    SiteRule("block", "example.org", "/es/"),
    SiteRule("block", "example.org", "/en/1"),
    SiteRule("allow", "com", "/fr/"),
    SiteRule("block", "com", "/de/"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    def group(i: int) -> Column:
        return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)([^?#]*)", i), F.lit(""))

    return F.translate(group(1), string.ascii_uppercase, string.ascii_lowercase), group(2)


def rule_of(host: Column, path: Column, rules: Sequence[SiteRule] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    fits = [((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
            for r in sorted(rules, key=lambda r: len(r.name), reverse=True)]
    ordered = sorted(rules, key=lambda r: len(r.name), reverse=True)
    return (F.coalesce(*[F.when(c, F.lit(r.name)) for c, r in zip(fits, ordered)]),
            F.coalesce(*[F.when(c, F.lit(r.verdict)) for c, r in zip(fits, ordered)]))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL: scheme, host labels, path words, query keys and fragment.

    Digits count as one sign each run, so that page numbers don't make tokens
    of their own. A null URL has no token.
    """
    plain = F.regexp_replace(F.lower(path), r"\d+", "0")
    query = F.regexp_replace(F.lower(F.regexp_extract(url, r"\?([^#]*)", 1)), r"=[^&]*", "")
    tagged = [F.transform(F.split(host, r"\."), lambda t: F.when(t != "", F.concat(F.lit("host:"), t))),
              F.transform(F.split(plain, r"[/._-]+"), lambda t: F.when(t != "", F.concat(F.lit("path:"), t))),
              F.transform(F.split(query, "&"), lambda t: F.when(t != "", F.concat(F.lit("query:"), t))),
              F.array(F.concat(F.lit("scheme:"), F.nullif(
                  F.lower(F.regexp_extract(url, r"^([^:/?#]*)://", 1)), F.lit(""))),
                  F.when(F.contains(url, F.lit("#")), F.lit("fragment")))]
    return F.coalesce(F.array_distinct(F.array_compact(F.concat(*tagged))), F.array().cast("array<string>"))


def _with_parts(pages: DataFrame) -> DataFrame:
    host, path = parts(F.col("url"))
    return pages.select(F.col("page_id"), F.col("url").cast("string").alias("url")).select(
        "page_id", "url", host.alias("host"), path.alias("path"))


def labelled_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[SiteRule] = RULES) -> DataFrame:
    """Return (tokens, verdict) of each URL with a known verdict.

    A URL that an explicit rule fits has that rule's verdict; another one is
    blocked if ``labels`` marks the page of its id as low quality, and allowed
    if it marks it as good. Pages without either are left to be judged.
    """
    marks = labels.select(F.col("doc_id").alias("page_id"), F.when(F.col("quality") == 0, "block").when(
        F.col("quality") == 1, "allow").alias("label"))
    _, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    known = _with_parts(pages).join(marks, "page_id", "left").select(
        tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"),
        F.coalesce(by_rule, F.col("label")).alias("verdict"))
    return known.where(F.col("verdict").isNotNull() & (F.size("tokens") > 0))


def token_classes(labelled: DataFrame, min_support: float = 0.002) -> DataFrame:
    """Return (token, item, n) of the frequent tokens: ``item`` is the smallest token of the same rows, ``n`` their number.

    Tokens that occur in exactly the same rows (by two 64-bit hashes of them)
    make one item, and tokens of every row none: with or without them a rule
    has the same support and confidence. So tokens that always stand together,
    however many, cost mining no more than one.
    """
    rows = labelled.select(F.monotonically_increasing_id().alias("row"), "tokens")
    occurs = rows.select("row", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("a"),
        F.bit_xor(F.xxhash64("row", F.lit(1))).alias("b"))
    total = labelled.count()
    often = occurs.where((F.col("n") < total) & (F.col("n") >= total * min_support - 1e-9))
    grouped = often.groupBy("n", "a", "b").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"))
    return grouped.select(F.explode("tokens").alias("token"), "item", "n")


def mine(labelled: DataFrame, classes: DataFrame, min_support: float = 0.002,
         min_confidence: float = 0.8) -> DataFrame:
    """Mine rules (antecedent, verdict, confidence, support, lift) by FP-growth.

    Every labelled URL is a transaction of the items of its tokens (see
    ``token_classes``) and its verdict. Rules are kept from the given support
    and confidence on if they lift their verdict above its base rate, and
    dropped if leaving out one item gives a rule for the same verdict that is
    as sure. ``min_support`` bounds the number of frequent items, which is all
    that reaches the driver.
    """
    n = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = labelled.select(F.monotonically_increasing_id().alias("row"), "verdict", "tokens").select(
        "row", "verdict", F.explode_outer("tokens").alias("token"))
    baskets = rows.join(classes.select("token", "item"), "token", "left").groupBy("row", "verdict").agg(
        F.collect_set("item").alias("items")).select(
        F.array_append("items", F.concat(F.lit(_VERDICT), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence,
                     numPartitions=n).fit(baskets)
    target = F.col("consequent")[0]
    found = model.associationRules.where(
        F.startswith(target, F.lit(_VERDICT)) & ~F.exists(
            "antecedent", lambda t: F.startswith(t, F.lit(_VERDICT))) & (F.col("lift") > 1)).select(
        F.array_sort("antecedent").alias("antecedent"), F.substring(target, len(_VERDICT) + 1, 100).alias("verdict"),
        "confidence", "support", "lift")
    found = written(found, "url-rules-all")
    shorter = found.select(F.col("antecedent").alias("whole"), "verdict", F.col("confidence").alias("own"),
                           F.explode("antecedent").alias("left_out")).select(
        "whole", "verdict", "own", F.array_remove("whole", F.col("left_out")).alias("antecedent"))
    needless = shorter.join(found.select("antecedent", "verdict", "confidence"), ["antecedent", "verdict"]).where(
        "confidence >= own").select(F.col("whole").alias("antecedent"), "verdict").distinct()
    return found.join(needless, ["antecedent", "verdict"], "left_anti")


def index(mined: DataFrame, classes: DataFrame) -> DataFrame:
    """List each rule under the rarest item of its antecedent."""
    pairs = mined.select("antecedent", "verdict", "confidence", "support", F.explode("antecedent").alias("item")).join(
        classes.select("item", "n").distinct(), "item")
    return pairs.groupBy("antecedent", "verdict", "confidence", "support").agg(
        F.min_by("item", F.struct("n", "item")).alias("item"))


def match(urls: DataFrame, listed: DataFrame, classes: DataFrame) -> DataFrame:
    """Return url, verdict, confidence and antecedent of the best mined rule for each (url, tokens) row.

    A URL has an item if it has any token of it. It looks its items up in the
    index, and a rule found there is verified against all of them. The surest
    rule decides, then the best supported, then the antecedent in text order.
    Urls are distinct; those that no rule fits are absent.
    """
    items = urls.select("url", F.explode("tokens").alias("token")).join(classes, "token").groupBy("url").agg(
        F.collect_set("item").alias("items"))
    hits = items.select("url", "items", F.explode("items").alias("item")).join(listed, "item").where(
        F.size(F.array_intersect("antecedent", "items")) == F.size("antecedent"))
    best = hits.groupBy("url").agg(F.max(F.struct(
        "confidence", "support", F.array_join("antecedent", " ").alias("antecedent"), "verdict")).alias("best"))
    return best.select("url", "best.verdict", "best.confidence", "best.antecedent")


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[SiteRule] = RULES, default: str = "allow",
          min_support: float = 0.002, min_confidence: float = 0.8) -> DataFrame:
    """Return page_id, host, path, rule, verdict, mined and confidence for every row of ``pages``.

    The longest explicit rule decides; where none fits, the best mined rule;
    where none matches, ``default``. Verdicts are found once per distinct URL
    and joined back, so a URL that many rows share costs one lookup. A null URL
    gets ``default``. Without any labelled URL nothing is mined.
    """
    labelled = written(labelled_urls(pages, labels, rules), "url-labels")
    parsed = _with_parts(pages)
    by_name, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": by_name, "ruled": by_rule})
    spark = pages.sparkSession
    if labelled.isEmpty():
        best = spark.createDataFrame([], "url string, verdict string, confidence double, antecedent string")
    else:
        classes = written(token_classes(labelled, min_support), "url-items")
        listed = written(index(mine(labelled, classes, min_support, min_confidence), classes), "url-rules")
        open_urls = ruled.where(F.col("ruled").isNull() & F.col("url").isNotNull()).select(
            "url", "host", "path").distinct().select(
            "url", tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
        best = match(open_urls, listed, classes)
    found = best.select("url", F.col("verdict").alias("by_mined"), "confidence", F.col("antecedent").alias("mined"))
    joined = ruled.join(found, "url", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce(
        "ruled", "by_mined", F.lit(default)).alias("verdict"), "mined", "confidence")
